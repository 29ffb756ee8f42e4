import random
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillstone.operators import calibrate, curate, current, metrics, ontology, predictors

ITEM = "rid string, grp string, qid string, qtype string, y int, pred int, conf double, p_gold double, has_text boolean"


def items(spark, rows):
    return metrics.scored(spark.createDataFrame([(f"r{i}", f"g{i % 3}", "q", "t", y, p, c, c, True) for i, (y, p, c) in enumerate(rows)], ITEM))


def test_hand_computed_curve(spark):
    s = items(spark, [(1, 1, 0.9), (1, 1, 0.8), (1, 0, 0.7), (1, 1, 0.6), (None, 1, 0.99), (1, None, 0.5)])
    curve = metrics.risk_coverage(s, ["qtype"])
    assert [(r.k, round(r.risk, 6)) for r in curve.orderBy("k").collect()] == [(1, 0), (2, 0), (3, 0.333333), (4, 0.25)]
    r = metrics.curve_summary(curve, ["qtype"], [0.0]).first()
    assert abs(r.aurc - (1 / 3 + 1 / 4) / 4) < 1e-12 and r.coverage_at_0 == 0.5
    assert metrics.risk_coverage(s.limit(0), ["qtype"]).count() == 0


def test_prefix_sums_match_a_sort(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.random() if rng.random() < 0.7 else 0.5, i, rng.randint(0, 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x double, id int, v int")
    got = {r.id: (r.k, r.cum_v) for r in metrics.prefix_sums(df, ["g"], [F.col("x"), F.col("id")], ["v"]).collect()}
    want, sums = {}, Counter()
    place = Counter()
    for g, x, i, v in sorted(rows):
        sums[g] += v
        place[g] += 1
        want[i] = (place[g], sums[g])
    assert got == want


def test_kappa(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (0, 1), (2, 2), (None, 1)], "a int, b int")
    r = metrics.kappa(df, []).first()
    assert r.n == 4 and abs(r.agreement - 0.75) < 1e-12 and abs(r.kappa - (0.75 - 5 / 16) / (1 - 5 / 16)) < 1e-12
    assert metrics.kappa(spark.createDataFrame([(1, 1)], "a int, b int"), []).first().kappa == 1


def test_thresholds(spark):
    right = items(spark, [(1, 1, 0.9995)] * 600)
    wrong = items(spark, [(1, 0, 0.9995)] * 600)
    t = lambda s: {r.alpha: r.threshold for r in calibrate.certify(s, ["qtype"]).collect()}
    assert t(right) == {0.01: 0.5, 0.02: 0.5, 0.05: 0.5} and t(wrong) == {0.01: None, 0.02: None, 0.05: None}
    assert set(t(items(spark, [(1, 1, 0.9)] * 2)).values()) == {None}
    policy = spark.createDataFrame([("t", 0.9), ("t", None), ("u", 0.7), ("u", 0.8)], "k string, threshold double")
    assert {r.k: r.threshold for r in calibrate.strictest(policy, ["k"]).collect()} == {"t": None, "u": 0.8}


def test_temperature_recovers(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    z = rng.normal(size=(3000, 3)) * 2
    p = np.exp(z / 2.5)
    p /= p.sum(axis=1, keepdims=True)
    y = [int(rng.choice(3, p=q)) for q in p]
    df = spark.createDataFrame([("t", [float(v) for v in a], b) for a, b in zip(z, y)], "g string, z array<double>, y int")
    assert abs(calibrate.fit_temperature(df, ["g"], "z", "y").first().t - 2.5) < 0.35


def test_majority_ties_are_masked(spark):
    q = "map<string, struct<label:string>>"
    rows = [("k", {"a": ("x",), "b": ("1",)}), ("k", {"a": ("x",), "b": ("2",)}), ("k", {"a": ("y",), "c": (None,)}), (None, {"a": ("z",)})]
    got = {tuple(r) for r in curate.majority_labels(spark.createDataFrame(rows, f"key string, questions {q}"), "key").collect()}
    assert got == {("k", "a", "x", 2, 1), (None, "a", "z", 1, 0)}


def test_temporal_parts(spark):
    rows = [("new", date(2024, 1, 1)), ("new", date(2024, 2, 1)), ("mixed", date(2024, 1, 1)), ("mixed", date(2020, 1, 1)), ("null", None)]
    got = {r.c: (r.part, r.n_new_in_old) for r in curate.temporal_parts(spark.createDataFrame(rows, "c string, d date"), "c", "d", "2023-01-01").collect()}
    assert got["new"] == ("test", 0) and got["mixed"][0] != "test" and got["mixed"][1] == 1 and got["null"][0] != "test"


def test_current_rows(spark):
    e = spark.createDataFrame([([("a", "2020", None), ("b", "2021", None), ("c", "2022", "2023"), ("d", "2021", None)],), ([("x", None, "2019")],), ([],)], "e array<struct<text:string,from:string,to:string>>")
    got = e.select(current.current_text(F.col("e")), current.current_or_last(F.col("e")).getField("text"), F.size(current.in_force(F.col("e"), F.lit("2023")))).collect()
    assert [tuple(r) for r in got] == [("b", "a", 3), (None, "x", 0), (None, None, 0)]
    df = spark.createDataFrame([("k", 1, False), ("k", 2, True), ("j", 1, False)], "id string, seq int, skipped boolean")
    assert [tuple(r) for r in current.latest(df, ["id"], ["seq"], "not skipped").collect()] == [("j", 1, False)]


def test_round_robin_and_quotas(spark):
    df = spark.range(100).selectExpr("id", "if(id < 90, 'big', if(id < 97, 'mid', 'few')) as s")
    n = Counter(r.s for r in curate.round_robin(df, "s", "id", 20).collect())
    assert n == {"few": 3, "mid": 7, "big": 10}
    n = Counter(r.s for r in curate.quota_sample(df, "s", "id", {"few": 5, "mid": 5, "big": 2}).collect())
    assert sum(n.values()) == 12 and n["few"] == 3 and n["mid"] >= 5


def brute_fills(key, coalition):
    slots = [r for p in key.split(";") for r in [p.split(":")[0]] * int(p.split(":")[1])]

    def place(slots, people):
        return not slots or any(slots[0] in ontology.SEATS[p] and place(slots[1:], people[:i] + people[i + 1 :]) for i, p in enumerate(people))

    return place(slots, list(coalition))


@pytest.mark.parametrize("question", sorted(ontology.COALITIONS))
def test_reachable_groups_equal_matching(question):
    roles = ["CEO", "CHAIR", "DEPUTY_CHAIR", "BOARD_MEMBER", "PARTNER", "EXECUTIVE_MEMBER", "PROKURIST"]
    from itertools import combinations_with_replacement

    reach = set(ontology.reachable(ontology.COALITIONS[question]))
    for k in (1, 2, 3):
        for combo in combinations_with_replacement(sorted(roles), k):
            key = ";".join(f"{r}:{n}" for r, n in sorted(Counter(combo).items()))
            assert (key in reach) == brute_fills(key, ontology.COALITIONS[question])


def test_rule_answers(spark):
    g = lambda t: tuple(ontology.parse_group(t))
    rows = [
        ("rule", [g("CEO:1"), g("CHAIR:1")], False, "sole_specific_roles", "1", True),
        ("rule", [g("SIGNATORY:1")], True, None, "1", None),
        ("rule", [g("*ALL_BOARD")], False, "board_jointly", "all_board", False),
        ("rule", [g("PROKURIST:2")], False, "prokura_only_rule", "2", False),
        ("uninterpretable", [g("CEO:1")], False, None, None, None),
        ("none", [], False, "no_rule_registered", None, False),
        ("rule", [g("BOARD_MEMBER:3")], False, "joint_three_plus", "3+", False),
        ("rule", [g("CHAIR:1"), g("BOARD_MEMBER:2")], False, "mixed_alternatives", "1", False),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], f"i int, s string, a array<{ontology.GROUP}>, p boolean")
    out = ontology.answers(F.col("s"), F.col("a"), F.col("p"))
    got = {r.i: (r.rule_type, r.min_signers, r.ceo_alone) for r in df.select("i", *[c.alias(q) for q, c in out.items()]).collect()}
    assert got == {i: r[3:] for i, r in enumerate(rows)}


def test_consistency(spark):
    q = ontology.STRUCTURAL
    said = [
        (1, {"rule_type": "sole_ceo", "ceo_alone": "false"}, False),
        (2, {"rule_type": "sole_ceo", "ceo_alone": "true", "min_signers": "1"}, True),
        (3, {"rule_type": "sole_ceo"}, True),
        (4, {"ceo_alone": "true", "ceo_with_one_board_member": "false"}, False),
        (5, {"chair_alone": "true", "min_signers": "2"}, False),
        (6, {}, True),
    ]
    df = spark.createDataFrame([(i, *[d.get(x) for x in q]) for i, d, _ in said], "id int, " + ", ".join(f"{x} string" for x in q))
    assert {r.id: r.consistent for r in ontology.consistent(df, "id").collect()} == {i: ok for i, _, ok in said}


def test_predictors(spark):
    s = items(spark, [(0, 1, 0.5), (0, 1, 0.6), (2, 1, 0.7)])
    import math

    got = {r.y: r.logit for r in predictors.majority_prior(s).collect()}
    assert abs(got[0] - math.log(3 / 6)) < 1e-12 and abs(got[1] - math.log(1 / 6)) < 1e-12
    rows = spark.createDataFrame([(f"apfel birne {i}", "obst") for i in range(8)] + [(f"hammer zange {i}", "werk") for i in range(8)] + [(None, "obst"), ("nagel", None)], "t string, l string")
    model = predictors.text_classifier(rows, "t", "l")
    out = model.transform(predictors.with_grams(spark.createDataFrame([("apfel",), ("zange",)], "t string"), "t")).select("prediction").collect()
    assert out[0].prediction != out[1].prediction
    assert predictors.text_classifier(rows.where("l = 'obst'"), "t", "l") is None
    assert spark.range(1).select(predictors.keyword_rule(F.lit("vertritt selbständig"), ["selbständig"], ["gemeinsam"])).first()[0] is True


def test_both_texts_are_redacted_and_masked(spark, tmp_path):
    from quillstone.plans.rules import masked_names, redacted_texts

    rows = [(1, "Ola Nordmann, a@b.no", "kari@c.no og Ola Nordmann", ["Ola Nordmann"]), (2, None, "signeres av Kari Hansen, x@y.no", None), (3, None, None, ["A"]), (4, "alene", "", None)]
    spark.createDataFrame(rows, "record_id bigint, signature_text string, procuration_text string, person_names array<string>").write.parquet(f"{tmp_path}/no_record.parquet")
    got = sorted(tuple(r) for r in redacted_texts(spark, str(tmp_path)).collect())
    assert got == [(1, "Ola Nordmann, [EMAIL]", "[EMAIL] og Ola Nordmann", 2), (2, None, "signeres av Kari Hansen, [EMAIL]", 1), (3, None, None, None), (4, "alene", "", 0)]
    got = sorted(tuple(r) for r in masked_names(spark, str(tmp_path)).collect())
    assert got == [(1, "[PERSON_1], a@b.no", "kari@c.no og [PERSON_1]", False), (2, None, "signeres av Kari Hansen, x@y.no", True), (4, "alene", "", False)]
