import json

from pyspark.sql import functions as F

from quillstone.operators import phrases, requests
from quillstone.functions import privacy


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def roles(*rs):
    return F.array(*[F.struct(F.lit(r).alias("role"), F.lit(1).alias("count")) for r in rs])


def test_state_leaves_out_empty_fields(spark):
    j = one(spark, requests.state(F.lit("NO"), F.lit(None).cast("string"), F.lit("a"), F.lit(""), roles("X")))
    assert list(json.loads(j)) == ["jurisdiction", "signature_rule", "roles"]


def test_label_errors(spark):
    q = "map<string,struct<type:string,label:string>>"
    rows = [({"rule_type": ("choice", "sole_ceo"), "min_signers": ("choice", "4"), "a": ("noul", "true"), "b": ("noul", "maybe"), "c": ("score", "4"), "d": ("noul", None), "e": ("x", "1")},)]
    got = spark.createDataFrame(rows, f"q {q}").select(requests.label_errors(F.col("q"))).first()[0]
    assert sorted(got) == ["b: no yes or no", "c: no level", "e: unknown type", "min_signers: no option"]


def test_applicable(spark):
    q = F.create_map(*[x for k in ("ceo_alone", "chair_with_member", "rule_type", "ceo_with_two_members") for x in (F.lit(k), F.lit(1))])
    keys = lambda j, *rs: sorted(one(spark, F.map_keys(requests.applicable(q, F.lit(j), roles(*rs)))))
    assert keys("AT", "Geschäftsführer") == ["ceo_alone", "rule_type"]
    assert keys("AT", "Obmann") == ["chair_with_member", "rule_type"]
    assert keys("DK", "Direktør", "Formand") == ["ceo_alone", "ceo_with_two_members", "chair_with_member", "rule_type"]
    assert len(keys("NO", "x")) == 4


def test_lines_there_and_back(spark):
    lines = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(a).alias("label"), F.lit(t).alias("token"), F.lit(x).alias("text")) for o, a, t, x in ((2, "B", "PERSON_2", "zwei"), (1, "A", "PERSON_1", "eins"))])
    text = one(spark, requests.render(lines))
    assert text == "A [PERSON_1]: eins; B [PERSON_2]: zwei"
    assert [tuple(r) for r in one(spark, requests.split_lines(F.lit(text + "; ohne")))] == [("A", "eins"), ("B", "zwei"), (None, "ohne")]


def test_abstain_priority(spark):
    why = lambda r, c, t, k, e: one(spark, requests.abstain(F.lit(r), F.lit(c), F.lit(t).cast("double"), F.lit(k), F.lit(e)))
    assert why(True, 0.9, 0.5, False, True) == "experimental" and why(True, 0.1, 0.5, True, False) == "name risk"
    assert why(False, 0.4, 0.5, False, False) == why(False, 0.9, None, True, False) == "threshold"
    assert why(False, 0.5, 0.5, False, False) == "inconsistent" and why(False, 0.5, 0.5, True, False) is None


def test_schema_driven_changes(spark):
    df = spark.createDataFrame([(1, ({"x": "a@b.no"}, [("c@d.no", "1.1.1970", 3)], None), "e@f.no")], "id int, s struct<m:map<string,string>,l:array<struct<t:string,`fødselsdato`:string,n:int>>,z:struct<t:string>>, cpr string")
    out = requests.map_strings(requests.drop_keys(df, set(privacy.PERSONAL_KEYS)), privacy.redact)
    assert out.columns == ["id", "s"]
    assert out.first().asDict(recursive=True) == {"id": 1, "s": {"m": {"x": "[EMAIL]"}, "l": [{"t": "[EMAIL]", "n": 3}], "z": None}}


def test_secrets(spark):
    df = spark.createDataFrame([(1, "ok\napi_key = abcdef123\nAKIA" + "A" * 16), (2, None), (3, "")], "id int, t string")
    assert sorted(tuple(r) for r in requests.secret_lines(df, "id", "t").collect()) == [(1, 1, "assigned secret"), (1, 2, "access key")]


def test_phrases(spark):
    read = lambda t: one(spark, phrases.read_line(F.lit(t)))
    assert read("vertritt seit 1.1.2020 selbständig").kind == "sole"
    r = read("vertritt gemeinsam mit einem weiteren Geschäftsführer oder einem Prokuristen.")
    assert (r.kind, list(r.partners)) == ("joint", ["CEO", "PROKURIST"])
    assert read("ist nicht vertretungsbefugt").kind == "none"
    assert read("gemeinsam mit [PERSON_2]") is read("gemeinsam mit Herrn X") is read("gemeinsam oder selbständig") is read("unklar") is read("gemeinsam mit Person A") is None


def test_company_rules(spark):
    joint = "gemeinsam mit einem weiteren Geschäftsführer"
    rows = [
        ("a", "CEO", "selbständig", "E"), ("a", "CEO", "selbständig", None),
        ("b", "CEO", joint, "G"), ("b", "CEO", joint + " oder einem Prokuristen", "G"),
        ("c", "CEO", "selbständig", "G"),
        ("d", "OTHER", "selbständig", "E"),
        ("e", "CHAIR", "selbständig", "E"), ("e", "CEO", "nicht vertretungsbefugt", "X"),
        ("f", "CEO", "selbständig", "E"), ("f", "CEO", joint, "G"),
    ]
    got = {r.company: (list(r.alternatives), r.person_specific) for r in phrases.company_rules(spark.createDataFrame(rows, "company string, office string, text string, code string")).collect()}
    assert got == {"a": (["CEO:1"], False), "b": (["CEO:2"], True), "e": (["CHAIR:1"], False), "f": (["CEO:2"], True)}


def test_rules_come_from_the_wording(spark, tmp_path):
    from quillstone.plans.requests import representation_rules

    def extract(*entries):
        return "<AUSZUG_V2_RESPONSE>" + "".join(f'<FUN PNR="{i}" FKEN="GF"><FU_DKZ10>{e}</FU_DKZ10></FUN>' for i, e in enumerate(entries)) + "</AUSZUG_V2_RESPONSE>"

    code = lambda c, *ts: f"<VART><CODE>{c}</CODE></VART>" + "".join(f"<TXTVERTR>{t}</TXTVERTR>" for t in ts)
    bodies = {
        1: extract(code("E")),
        2: extract(code("G", "vertritt gemeinsam mit einem weiteren Geschäfts-", "führer")),
        3: extract(code("G")),
        4: extract(code("E"), code("G", "unklar")),
        5: extract(code("E", "gemeinsam mit einem Prokuristen")),
        6: extract(code("E"), ""),
        7: extract(code("G") + "<TEXT>vertritt gemeinsam mit</TEXT><TEXT>einem Prokuristen</TEXT><TXTVERTR>einem Prokuristen</TXTVERTR>"),
        8: extract(code("E"), code("X")),
    }
    spark.createDataFrame(list(bodies.items()), "extract_id bigint, body string").write.parquet(f"{tmp_path}/at_extract.parquet")
    got = {r.company: list(r.alternatives) for r in representation_rules(spark, str(tmp_path)).collect()}
    assert got == {1: ["CEO:1"], 2: ["CEO:2"], 7: ["CEO:1;PROKURIST:1"], 8: ["CEO:1"]}


def test_all_four_reasons(spark, tmp_path):
    from quillstone.plans.requests import decision_reasons

    texts = {0: "Signatur av Ola Nordmann alene.", 2: "Selskapet tegnes av Styrets Leder."}
    members = [(f"r{i}", "NO", ((texts.get(i, "Daglig leder alene."), None, [("Daglig leder", 1)]),)) for i in range(400)]
    state = "state:struct<signature_rule:string,procuration_rule:string,roles:array<struct<role:string,count:int>>>"
    spark.createDataFrame(members, f"rid string, jurisdiction string, request struct<{state}>").write.parquet(f"{tmp_path}/dedup_member.parquet")
    items = [(f"r{i}", q, t, p, p, 0.3 if i == 3 else 0.99) for i in range(400) for q, t, p in (("ceo_alone", "noul", 1), ("prokura_joint", "noul", 1), ("parseable", "noul", 1), ("min_signers", "choice", int(i == 1)))]
    spark.createDataFrame(items, "rid string, qid string, qtype string, y int, pred int, conf double").write.parquet(f"{tmp_path}/item.parquet")
    got = {(r.qtype, r.reason): r.n for r in decision_reasons(spark, str(tmp_path)).collect()}
    want = {("noul", "name risk"): 2, ("noul", "inconsistent"): 1, ("noul", "experimental"): 400, ("choice", "name risk"): 1, ("choice", "inconsistent"): 1}
    assert {k: got.get(k) for k in want} == want and sum(got.values()) == 1600 and got["noul", "answered"] >= 795


def test_secret_scan_has_every_kind(spark, tmp_path):
    from quillstone.plans.requests import secret_scan

    a = "a" * 45
    lines = {
        "private key": "-----BEGIN RSA PRIVATE KEY-----", "access key": "AKIA" + "A" * 16, "personal token": "ghp_" + a, "web token": f"eyJ{a}.{a}.{a}", "assigned secret": "passwd=abcdef1", "quoted secret": '"token": "abcdefghijkl"',
        "fine-grained token": "github_pat_" + a, "model hub token": "hf_" + a, "service key": "sk-ant-" + a, "birth date": "Fødselsdato: 1.1.1970", "CPR number": "310170-1234",
    }
    spark.createDataFrame([(1, "\n".join([*lines.values(), "310270-1234", "x310170-1234", "token"]))], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.kind: r.n for r in secret_scan(spark, str(tmp_path)).collect()} == {k: 1 for k in lines}


def test_rules_of_bodies(spark):
    import json

    from quillstone.operators import bodies, ontology

    def body(rule=None, ident=None, combos=None, text=None, routine="OK"):
        return json.dumps({"status": {"rutineStatus": {"kode": routine}, "regelStatus": {"kode": rule, "regelIdent": ident}}, "signeringsGrunnlag": {"signaturProkuraRoller": {"signaturProkuraFritekst": text}}, "signeringsKombinasjon": {"kombinasjon": combos}})

    two = [{"navn": "A"}, {"navn": "B"}, {"navn": "C"}]
    rows = [
        (1, body("RF", "R0001", [{"kode": "R0005"}, {"kode": "X9"}, {"kode": None}, {"kode": "R0005"}])),
        (2, body("RF", None, {"kode": "R0001"}, " Styrets  leder ALENE. ")),  # a lone object
        (3, json.dumps(body("RF", None, [{"kode": "SIFE", "personRolleKombinasjon": two}]))),  # wrapped
        (4, body("RI", None, [{"kode": "STYR"}])),
        (5, body("RI", None, None, "Styret og en til")),
        (6, body("RT", None, [{"kode": "R0001"}])),
        (7, body("RF", "R0001", None, None, "NA")),
        (8, "{"),
        (9, None),
        (2, body("RF", None, {"kode": "R0001"}, " Styrets  leder ALENE. ")),
    ]
    df = spark.createDataFrame([(i, "o", "signatur", b, "x") for i, b in rows], "lookup_id bigint, orgnr string, kind string, body string, code string")
    s = bodies.signing(bodies.lookup_codes(df))
    level, least = bodies.ambiguity(s), ontology.min_signers(F.col("status"), F.col("alternatives"), F.col("statutory"))
    got = {r.lookup_id: r for r in s.select("*", level.alias("level"), least.alias("least")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and s.count() == 6
    assert (got[1].rule_codes, got[1].unmapped, got[1].least, got[1].level) == (["R0005", "R0001"], ["X9"], "1", None)
    assert (got[2].least, got[2].level) == ("1", 0)
    assert (got[3].person_specific, got[3].alternatives[0].roles[0].n, got[3].least) == (True, 3, "3+")
    assert (got[4].status, got[4].least) == ("none", "all_board") and (got[5].status, got[5].least) == ("uninterpretable", None)
    assert (got[6].status, got[6].rule_codes, got[6].alternatives) == ("uninterpretable", [], [])
    p = [
        (1, body("RF", "R0005", [{"kode": "PROK"}])),
        (2, body("RF", "R0005", None)),
        (3, body(None, None, None)),
        (4, body("RT", None, None, None, "NA")),
        (5, body("RI", None, None, "noe")),
        (6, body("RF", "POFE", [{"kode": "R0001"}])),
    ]
    df = spark.createDataFrame([(i, "o", "prokura", b) for i, b in p], "lookup_id bigint, orgnr string, kind string, body string")
    assert {r.lookup_id: (r.present, r.mode) for r in bodies.procuration(bodies.lookup_codes(df)).collect()} == {1: (True, "mixed"), 2: (True, "joint"), 3: (False, None), 4: (None, None), 5: (True, None), 6: (True, "mixed")}


def test_lines_without_text_count_by_their_code(spark):
    rows = [("a", "CEO", None, "E"), ("b", "CEO", "", "G"), ("c", "CEO", None, "E"), ("c", "BOARD_MEMBER", None, "X"), ("d", "CEO", "vertritt gemeinsam mit einem Prokuristen", "G"), ("d", "CEO", None, "E"), ("e", "CEO", "vertritt gemeinsam mit einem Geschäftsführer", "G")]
    got = {r.company: (r.alternatives, r.person_specific) for r in phrases.company_rules(spark.createDataFrame(rows, "company string, office string, text string, code string")).collect()}
    assert got == {"a": (["CEO:1"], False), "c": (["CEO:1"], False), "d": (["CEO:1;PROKURIST:1"], True), "e": (["CEO:2"], False)}


def test_lookup_answers_queue_no_rows_for_python(spark, tmp_path):
    import unicodedata

    from quillstone.operators import ontology
    from quillstone.plans import bodies as plans

    body = lambda text: json.dumps({"status": {"rutineStatus": {"kode": "OK"}, "regelStatus": {"kode": "RF"}}, "signeringsGrunnlag": {"signaturProkuraRoller": {"signaturProkuraFritekst": text}}, "signeringsKombinasjon": {"kombinasjon": [{"kode": code}]}})
    code, (said, _) = next(iter(ontology.RULES.items()))
    texts = [f"\u3000{said.upper()} .", unicodedata.normalize("NFD", said), "andre ord", " \u00a0", None]
    rows = [(i, "1", "signatur", body(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "lookup_id bigint, orgnr string, kind string, body string").write.parquet(str(tmp_path / "fullmakt_signatur_rf.parquet"))
    found = plans.lookup_answers(spark, str(tmp_path))
    assert {r.lookup_id: r.ambiguity for r in found.collect()} == {0: 0, 1: 0, 2: 1, 3: None, 4: None}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
