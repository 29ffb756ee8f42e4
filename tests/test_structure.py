import json

from quillstone.operators import structure as S


def lookups(spark, bodies):
    rows = [(i, b, "clash") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "lookup_id bigint, body string, code string")


def rows(df):
    return sorted((r.child, r.record_id, r.pos1, r.pos2, r.pos3, r.code) for r in df.collect())


FULL = {"signeringsGrunnlag": {"kode": "SF"}, "signeringsKombinasjon": {"kombinasjon": [{"kode": "R1", "personRolleKombinasjon": [{"rolle": {"kode": "LEDE"}}, {"rolle": None}, None]}, {"personRolleKombinasjon": {"rolle": {"kode": "DAGL"}}}]}}
WANT = [("grunnlag", -1, -1, "SF"), ("kombinasjon", 0, -1, "R1"), ("kombinasjon", 1, -1, ""), ("kombinasjon_person", 0, 0, "LEDE"), ("kombinasjon_person", 0, 1, ""), ("kombinasjon_person", 1, 0, "DAGL")]


def test_lists_lone_objects_and_missing_codes(spark):
    got = rows(S.lookup_nodes(lookups(spark, [json.dumps(FULL)])))
    assert [(c, a, b, k) for c, _, a, b, _, k in got] == WANT


def test_text_inside_text_is_read_through(spark):
    inner = FULL | {"signeringsKombinasjon": json.dumps(FULL["signeringsKombinasjon"])}
    got = rows(S.lookup_nodes(lookups(spark, [json.dumps(json.dumps(inner))])))
    assert [(c, a, b, k) for c, _, a, b, _, k in got] == WANT


def test_unreadable_null_and_empty_give_nothing(spark):
    bodies = [None, "", "{", json.dumps(FULL)[:-5], "[]", "3", '"x"', json.dumps({"signeringsGrunnlag": {"kode": None}}), "[" * 5000]
    assert rows(S.lookup_nodes(lookups(spark, bodies))) == []
    assert S.lookup_nodes(lookups(spark, bodies).limit(0)).count() == 0


def test_repeated_delivery_counts_once(spark):
    df = lookups(spark, [json.dumps(FULL)])
    assert len(rows(S.lookup_nodes(df.unionAll(df)))) == len(WANT)


def test_lone_combination_is_a_list_of_one(spark):
    got = rows(S.lookup_nodes(lookups(spark, [json.dumps({"signeringsKombinasjon": {"kombinasjon": {"kode": "R7"}}})])))
    assert got == [("kombinasjon", 0, 0, -1, -1, "R7")]


def test_very_long_list(spark):
    body = json.dumps({"signeringsKombinasjon": {"kombinasjon": [{"kode": str(i)} for i in range(20000)]}})
    assert S.lookup_nodes(lookups(spark, [body])).count() == 20000


XML = """<?xml version="1.0" encoding="ISO-8859-1"?><a:AUSZUG_V2_RESPONSE xmlns:a="x:y"><a:FIRMA/><a:FUN><a:FU_DKZ10><a:TXTVERTR> vertritt
   allein &amp; <![CDATA[stets]]></a:TXTVERTR><a:TXTVERTR/><a:TXTVERTR>zwei</a:TXTVERTR></a:FU_DKZ10></a:FUN><a:FUN/><a:FUN><a:FU_DKZ10/><a:FU_DKZ10><a:TXTVERTR>ö</a:TXTVERTR></a:FU_DKZ10></a:FUN></a:AUSZUG_V2_RESPONSE>"""


def test_extract_places(spark):
    df = spark.createDataFrame([(7, XML), (8, XML[:-3]), (9, None), (7, XML)], "extract_id bigint, body string")
    assert rows(S.extract_nodes(df)) == [("txtvertr", 7, 0, 0, 0, "vertritt allein & stets"), ("txtvertr", 7, 0, 0, 2, "zwei"), ("txtvertr", 7, 2, 1, 0, "ö")]


def test_subtype_tables_keep_parent_links(spark):
    from pyspark.sql import functions as F

    tree = S.lookup_nodes(lookups(spark, [json.dumps(FULL)]))
    persons = S.subtype(tree, "kombinasjon_person", record_id=F.col("record_id"), combination=F.col("pos1"), person=F.col("pos2"), role=F.col("code"))
    combos = S.subtype(tree, "kombinasjon", record_id=F.col("record_id"), combination=F.col("pos1"))
    assert persons.join(combos, ["record_id", "combination"], "left_anti").count() == 0


def test_holders_in_every_shape(spark):
    person = lambda n, k: {"navn": n, "rolle": {"kode": k}}
    body = {
        "signeringsGrunnlag": {"muligeSigneringsRoller": {"personRolleGrunnlag": person("A  B", "LEDE")}, "signaturProkuraRoller": {"personRolleGrunnlag": [person("C", "MEDL"), {"navn": "D"}]}},
        "signeringsKombinasjon": {"kombinasjon": {"personRolleKombinasjon": person("A\u030a", "DAGL")}},
    }
    want = [("A B", "LEDE"), ("C", "MEDL"), ("D", "?"), ("\u00c5", "DAGL")]
    df = spark.createDataFrame([("1", json.dumps(body)), ("2", json.dumps(json.dumps(body))), ("2", json.dumps(body)), ("3", "{"), ("4", None)], "orgnr string, body string")
    assert sorted(tuple(r) for r in S.holders(df).collect()) == [(n, *w) for n in "12" for w in want]


def test_key_paths_of_wrapped_bodies(spark):
    from quillstone.sources.discover import key_paths

    df = spark.createDataFrame([(json.dumps(json.dumps({"a": [{"b": 1}]})),), (json.dumps({"a": json.dumps({"b": "{"})}),)], "body string")
    assert sorted(tuple(r) for r in key_paths(df, "body").collect()) == [("a", 2), ("a.b", 1), ("a[].b", 1)]


def test_wraps_and_depth_without_bounds():
    import json

    from quillstone.operators import structure as S

    body = {"signeringsGrunnlag": {"kode": "A"}}
    rows = lambda text: [r[:3] for r in S.run_automaton(S.LOOKUP_SHAPES, "body", S.read_json(text))]
    wrapped = json.dumps(body)
    for _ in range(12):
        wrapped = json.dumps(wrapped)
    assert rows(wrapped) == [("grunnlag", (), "A")]
    deep = "[" * 200_000 + "]" * 200_000
    assert rows('{"other": ' + deep + ', "signeringsGrunnlag": {"kode": "B"}}') == [("grunnlag", (), "B")]
    assert rows('{"other": ' + deep[:-1] + "}") == []


def test_deep_reader_equals_the_plain_one():
    import json

    import pytest

    from quillstone.operators.structure import _read_deep

    for text in ['{"a": [1, -2.5e3, "x\\u00e5\\n", null, true, {}], "b": {"c": []}, "a": 2}', " [ ] ", '"t"', "12", "[[1],[2,[3]]]"]:
        assert _read_deep(text) == json.loads(text)
    for text in ["", "{", "[1,]", '{"a" 1}', "[1] 2", "nul", '{"a":1,}', "[1 2]", "01"]:
        with pytest.raises(ValueError):
            _read_deep(text)
