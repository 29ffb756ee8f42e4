import gzip
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.functions import keys, privacy, prob
from quillstone.operators import registers
from quillstone.sources import discover, paged, readers, sinks


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_probabilities(spark):
    p = one(spark, prob.softmax(arr(1, 2, "-inf")))
    assert p[2] == 0 and abs(sum(p) - 1) < 1e-12 and abs(p[1] - 1 / (1 + math.exp(-1))) < 1e-12
    assert abs(one(spark, prob.temper(arr(0.9, 0.1), 2.0))[0] - 0.75) < 1e-12
    assert one(spark, prob.argmax(arr(0.2, 0.5, 0.5))) == 1
    assert abs(one(spark, prob.expected_level(arr(0.2, 0.3, 0.5))) - 1.3) < 1e-12
    assert abs(one(spark, prob.brier(arr(0.6, 0.4), F.lit(1))) - 0.72) < 1e-12
    assert abs(one(spark, prob.nll(arr(0, 1), F.lit(0))) - math.log(1e12)) < 1e-6
    assert one(spark, prob.align_logits(F.create_map(F.lit("b"), F.lit(1.0)), F.array(F.lit("a"), F.lit("b")))) == [-math.inf, 1.0]
    assert one(spark, prob.option_index(F.lit("b"), F.array(F.lit("a"), F.lit("b")))) == 1
    assert one(spark, prob.percent_comma(F.lit(0.984))) == "98,4 %" and one(spark, prob.percent(F.lit(None).cast("double"))) == "–"


def test_keys(spark):
    assert one(spark, keys.ascii_key(F.lit("Fødsels-Dæto"))) == "fodselsdaeto"
    assert one(spark, keys.template_key(F.lit("am 1.2.2020 und 2020-02-01"))) == "am <DATE> und <DATE>"
    assert one(spark, keys.phrase_key(F.lit(" Gemeinsam  mit einem Prokuristen."))) == "einem prokuristen"
    assert [one(spark, keys.repeats(F.lit(n))) for n in (1, 6, 7, 20)] == [1, 2, 3, 4]
    assert one(spark, keys.bucket(F.lit(20), [20, 40])) == "<40" and one(spark, keys.bucket(F.lit(20), [20, 40], True)) == "<=20"
    assert one(spark, keys.hash_split(F.lit(None).cast("string"))) is None
    assert one(spark, keys.roles_signature(F.expr("array(struct('A' as role, 2 as count))"))) == "A:2"


def valid(nine):
    d = [int(c) for c in nine]
    a = (11 - sum(x * w for x, w in zip(d, privacy.NO_WEIGHTS[0])) % 11) % 11
    b = (11 - sum(x * w for x, w in zip([*d, a], privacy.NO_WEIGHTS[1])) % 11) % 11
    return f"{nine}{a}{b}" if a < 10 and b < 10 else None


def test_identity_numbers(spark):
    good = [v for v in (valid(f"{i:09d}") for i in range(120398700, 120398720)) if v]
    df = spark.createDataFrame([(g,) for g in good] + [("123",), (None,), ("abcdefghijk",)], "i string")
    got = [r[0] for r in df.select(privacy.valid_no_id(F.col("i"))).collect()]
    assert got == [True] * len(good) + [False, None, False]
    assert one(spark, privacy.valid_no_id(F.lit(good[0][:-1] + str((int(good[0][-1]) + 1) % 10)))) is False
    ten = "3790205001"
    k = sum(int(c) * w for c, w in zip(ten, privacy.EE_WEIGHTS[0])) % 11
    k = k if k < 10 else sum(int(c) * w for c, w in zip(ten, privacy.EE_WEIGHTS[1])) % 11 % 10
    assert one(spark, privacy.valid_ee_id(F.lit(f"{ten}{k}"))) is True
    assert one(spark, privacy.valid_ee_id(F.lit("37902300015"))) is False


def test_redaction(spark):
    i = next(v for v in (valid(f"{i:09d}") for i in range(120398700, 120398720)) if v)
    text = f"Ola, født 1.2.1970, {i}, 12345678901, a.b@c.no, geb. 1971 og år 1980"
    assert one(spark, privacy.redact(F.lit(text))) == "Ola, født [DATE], [ID], 12345678901, [EMAIL], geb. [DATE] og år 1980"
    assert one(spark, privacy.redactions(F.lit(text))) == 4
    assert one(spark, privacy.personal_key(F.lit("Fødsels-dato"))) is True


def test_masking(spark):
    names = F.array(F.lit("Kari Vik"), F.lit("Anne-Lise  Dahl"), F.lit("Kari Vik"))
    mask = lambda t: one(spark, privacy.mask_names(F.lit(t), names, ["lise"]))
    assert mask("Dahl og KARI VIKs stedfortreder; Anne Lise Dahl, xKari") == "[PERSON_1] og [PERSON_2] stedfortreder; [PERSON_1], xKari"
    assert mask("Lise signerer") == "Lise signerer"
    assert one(spark, privacy.mask_names(F.lit("Kari"), F.array().cast("array<string>"))) == "Kari"
    risk = lambda t: one(spark, privacy.residual_name(F.lit(t), ["styret"]))
    assert risk("Det er Per. Ja") and not risk("Alle i Styret. [PERSON_1] og NAV") and not risk("Se Fiktiv Holding AS") and not risk("")


def test_fragments(spark):
    f = lambda *xs: one(spark, registers.join_fragments(F.array(*[F.lit(x) for x in xs])))
    assert f("Geschäfts-", "führer und", "", "zeichnungs-", "und mehr") == "Geschäftsführer und zeichnungs- und mehr"
    extra = registers.append_missing(F.lit("mit einer Prokuristin"), F.array(F.lit("einer Pro-kuristin"), F.lit("allein")))
    assert one(spark, extra) == ["allein"]


def test_dates_and_scope(spark):
    df = spark.createDataFrame([("2020-02-01",), ("1.2.2020",), ("20200201",), ("x",), (None,)], "d string")
    assert [str(r[0]) for r in df.select(registers.try_dates(F.col("d"))).collect()] == ["2020-02-01"] * 3 + ["None"] * 2
    assert one(spark, registers.scope(F.lit("AS"), F.lit(None).cast("string"))) == "tier 1"


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write('{"a": 3}\n')
    assert sorted(r.a for r in readers.jsonl(spark, str(tmp_path / "*.js*"), "a int").collect()) == [1, 2, 3]
    d = tmp_path / "e"
    d.mkdir()
    for n, e in (("1", {"status_code": 200, "body": {"x": 1}}), ("2", {"status_code": 404, "body": None}), ("3", {"status_code": 200})):
        (d / f"{n}.json").write_text(json.dumps(e))
    assert [r.body.x for r in readers.envelopes(spark, str(d), "struct<x:int>").collect()] == [1]
    for n in ("ent_2024-01-01.gz", "ent_2024-02-01.gz", "other_2025-01-01.gz"):
        (tmp_path / n).write_text("")
    assert readers.snapshot(spark, str(tmp_path), "ent").endswith("ent_2024-02-01.gz")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("c.csv", "﻿kood;nimi\n1;Å\n2;B\n")
    assert [tuple(r) for r in readers.zipped_csv(spark, str(tmp_path / "c.zip"), ["kood", "nimi"]).collect()] == [("1", "Å"), ("2", "B")]
    (tmp_path / "p.jsonl").write_text('{"rid": "r", "qid": "q", "probabilities": {"a": 1.0, "b": 0.0}}\n')
    v = readers.predictions(spark, str(tmp_path / "p.jsonl")).first()["values"]
    assert v["a"] == 0 and abs(v["b"] - math.log(1e-12)) < 1e-9
    t = one(spark, readers.schema_types(F.lit("type A {\n  x: Int\n  y(z: Int): B\n}\ntype B implements C { w: Int }")))
    assert [(r.type, list(r.fields)) for r in t] == [("A", ["x", "y"]), ("B", ["w"])]
    assert one(spark, readers.scrape(F.lit("== no: 12 cached"), r"== (\w+): (\d+)", "kind", "n")).n == "12"
    assert readers.days(spark, "2024-01-30", "2024-02-02").count() == 4
    (tmp_path / "x.xml").write_text('<l xmlns:a="u"><a:r k="1"><a:v>x</a:v></a:r><a:r k="2"><a:v>y</a:v></a:r></l>')
    assert sorted(tuple(r) for r in readers.xml_documents(spark, str(tmp_path / "x.xml"), "r", "_k string, v string").collect()) == [("1", "x"), ("2", "y")]


def test_discovery(spark):
    df = spark.createDataFrame([('{"a": {"kode": "X"}, "b": [{"kode": 1}, {"c": null}]}',), ("{",), (None,)], "body string")
    assert {r.path: r.n for r in discover.key_paths(df, "body").collect()} == {"a": 1, "a.kode": 1, "b": 1, "b[].kode": 1, "b[].c": 1}
    assert sorted(tuple(r) for r in discover.coded_values(df, "body").collect()) == [("a.kode", "X", 1), ("b[].kode", "1", 1)]


def test_paged_source(spark, tmp_path):
    for i in range(25):
        (tmp_path / f"{i:03d}.json").write_text(json.dumps({"i": i}))
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged").options(root=str(tmp_path), page="25", bounds='["", "010", "\\uffff"]').load()
    assert df.count() == 25 and df.rdd.getNumPartitions() == 2
    slept = []
    slots = paged.Slots(5, clock=lambda: 0.0, sleep=slept.append)
    answers = iter([(503, {}), (429, {"retry_after": 1}), (200, {"rows": []})])
    assert paged.tried(lambda: next(answers), slots, sleep=slept.append)[0] == 200 and len(slept) == 4
    with pytest.raises(ValueError):
        paged.Slots(6)


def test_sinks(spark, tmp_path):
    df = spark.range(10)
    n = {r.route: r.n for r in sinks.routed(df, F.when(F.col("id") < 3, "ok").otherwise("risk"), str(tmp_path / "r")).collect()}
    assert n == {"ok": 3, "risk": 7} and spark.read.json(str(tmp_path / "r")).where("route = 'ok'").count() == 3
    sinks.parts(df.selectExpr("id", "'s' as split", "if(id < 5, 'a', 'b') as part"), "split", "part", str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).groupBy("part").count().count() == 2
    before = spark.createDataFrame(sinks.file_hashes(spark, str(tmp_path / "r")).collect(), "path string, sha256 string")
    sinks.append_log(df.selectExpr("id", "'x' as route"), str(tmp_path / "r"))
    assert {r.change for r in sinks.changed_files(before, sinks.file_hashes(spark, str(tmp_path / "r"))).collect()} >= {"added"}
    t = spark.createDataFrame([(1, "a@b.no"), (2, "x")], "id int, t string")
    assert [tuple(r) for r in sinks.rewrite(t, "t", privacy.redact(F.col("t")), ["id"]).collect()] == [(1, "[EMAIL]")]
    assert sinks.markdown(t.limit(1)).startswith("| id | t |")
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(20), most=10)


def test_words_of_plain_and_other_characters(spark):
    from quillstone.functions.text import words, words_joined

    texts = [chr(i) + "a" + chr(i).upper() + " 1" + chr(i) for i in [*range(1, 0x250), *range(0x2000, 0x2070), 0xFB01, 0x1E9E, 0x212A, 0x3D0]]
    texts += ["", " -- ", "a\u030aB", "Straße\nÆØÅ_x", "x" * 70_000 + "ß", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.w for r in df.select("i", words_joined("t").alias("w")).collect()}
    assert got == {i: " ".join(words(t)) for i, t in enumerate(texts)}
