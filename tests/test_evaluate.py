from pyspark.sql import functions as F

from quillstone.operators import evaluate, requests


def test_fallback_is_the_strictest_and_flagged(spark):
    wanted = spark.createDataFrame([("NO", "a"), ("AT", "a"), ("XX", "a"), ("XX", "b"), ("XX", "a"), ("XX", "c")], "j string, q string")
    policy = spark.createDataFrame([("NO", "a", 0.5), ("AT", "a", 0.9), ("NO", "b", 0.7), ("AT", "b", None)], "j string, q string, threshold double")
    got = {(r.j, r.q): (r.threshold, r.fallback) for r in evaluate.with_fallback(wanted, policy, "j", "q").collect()}
    assert got == {("NO", "a"): (0.5, False), ("AT", "a"): (0.9, False), ("XX", "a"): (0.9, True), ("XX", "b"): (None, True), ("XX", "c"): (None, True)}


def test_merging_and_adjudication(spark):
    asked = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "k int, id string")
    given = spark.createDataFrame([(1, "x", "A"), (2, "other", "B"), (3, None, "C")], "k int, id string, label string")
    got = {r.k: (r.label, r.status) for r in evaluate.merged(asked, given, "k", "id", "label").collect()}
    assert got == {1: ("A", "merged"), 2: (None, "id differs"), 3: ("C", "merged"), 4: (None, "missing")}
    votes = spark.createDataFrame([("i", "a", "1"), ("i", "b", "1"), ("j", "a", "1"), ("j", "b", "2"), ("k", "b", "3"), ("l", "a", "4")], "id string, annotator string, label string")
    judge = spark.createDataFrame([("i", "a"), ("j", "b"), ("l", "a")], "id string, annotator string")
    assert {r.id: (r.label, r.source) for r in evaluate.adjudicated(votes, judge, ["id"]).collect()} == {"i": ("1", "agreed"), "j": ("2", "adjudicated"), "l": ("4", "adjudicated")}


def test_coded_rules(spark):
    f = spark.createDataFrame([(1, "GF", "E"), (1, "GF", "E"), (1, "PR", "X"), (2, "GF", "E"), (2, "GF", "G"), (3, "VM", None), (4, "GF", "X")], "extract_id int, fken string, vart string")
    assert {r.extract_id: (r.offices, r.person_specific) for r in evaluate.coded_rules(f).collect()} == {1: (["GF"], False), 2: ([], True), 3: ([], True)}


def test_scrubbing(spark):
    got = spark.range(1).select(requests.scrub(F.lit("Styret ved Åse Berg-Lie [PERSON_1] a.b@c.no [sic]"), ["styret"]).alias("t"), requests.scrub(F.lit(None).cast("string"), []).alias("n")).first()
    assert (got.t, got.n) == ("Styret ved [X] [X] [PERSON_1] [EMAIL] [sic]", None)


def test_tempered(spark):
    r = spark.range(1).select(evaluate.tempered(F.lit(0.8), 1.0).alias("same"), evaluate.tempered(F.lit(0.8), 2.0).alias("flat"), evaluate.tempered(F.lit(None).cast("double"), 2.0).alias("none")).first()
    assert abs(r.same - 0.8) < 1e-12 and abs(r.flat - 2 / 3) < 1e-12 and r.none is None
