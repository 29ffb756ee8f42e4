from pyspark.sql import functions as F

from quillstone.functions.text import normalize_text, register_number, text_key, words
from quillstone.operators.components import roots
from quillstone.operators.skew import lookup_join


def test_words():
    assert words(None) == words("") == []
    assert words("Straße_1 Å!") == ["strasse", "1", "å"]


def test_keys(spark):
    df = spark.createDataFrame([("  Å – b. ",), (None,), ("STRAßE..",)], "t string")
    assert [tuple(r) for r in df.select(text_key(F.col("t")), normalize_text(F.col("t"))).collect()] == [("å - b", "Å – b."), ("", None), ("strasse", "STRAßE..")]


def test_register_number(spark):
    cases = [("NO", "NO 201 020 964 MVA", "201020964"), ("DK", "DK-90001206", "90001206"), ("AT", "FN 004049 A", "4049a"), ("AT", "1292a", "1292a"), ("AT", "ukjent", None), ("NO", "", None), ("NO", None, None), ("EE", "12", None)]
    df = spark.createDataFrame([(j, e) for j, e, _ in cases], "j string, e string")
    assert [r[0] for r in df.select(register_number(F.col("j"), F.col("e"))).collect()] == [w for _, _, w in cases]


def test_lookup_join_with_a_hot_key(spark, monkeypatch):
    import quillstone.operators.skew as skew

    monkeypatch.setattr(skew, "HOT_KEYS", 1)
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"))
    keyed = left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("v")).where("k <> '7'")
    got = lookup_join(left, keyed, "k", "n", "v")
    assert got.exceptAll(left.join(keyed.select("k", "v"), "k").select("id", "k", "v")).count() == 0
    assert got.count() == left.where("k <> '7'").count()
    assert lookup_join(left, keyed, "k", "n", "v", how="left").count() == 3000


def test_components_chain_and_hub(spark):
    chain = [(i, f"e{i}") for i in range(200)] + [(i + 1, f"e{i}") for i in range(199)]
    hub = [(1000 + i, "hub") for i in range(500)]
    ties = spark.createDataFrame(chain + hub + [(5000, None), (None, "hub"), (1000, "hub")], "member_id bigint, key string")
    nodes = spark.createDataFrame([(i,) for i in [*range(200), *range(1000, 1500), 5000, 6000]], "member_id bigint")
    got = {r.member_id: r.root_id for r in roots(ties, nodes).collect()}
    assert got == {i: 0 for i in range(200)} | {i: 1000 for i in range(1000, 1500)} | {5000: 5000, 6000: 6000}
    assert roots(ties.limit(0), nodes.limit(0)).count() == 0
