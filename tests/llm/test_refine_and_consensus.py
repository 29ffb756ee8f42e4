from pyspark.sql import Row

from quillstone.llm import consensus, refine

MEMBER = "member_id bigint, jurisdiction string, signature_key string, procuration_key string, has_text boolean, request struct<state struct<legal_form string, roles array<struct<role string, count int>>>>, first_id int"


def member(i, s, p=None, roles=(("A", 1), ("B", 2)), form="AS", j="NO", text=True):
    return (i, j, s, p, text, ((form, None if roles is None else [tuple(r) for r in roles]),), 0)


def test_copies(spark):
    rows = [
        member(5, "Styret, samlet!"),
        member(3, "STYRET  samlet", "", (("B", 2), ("A", 1))),
        member(3, "STYRET  samlet", "", (("B", 2), ("A", 1))),
        member(9, "styret samlet", "."),
        member(4, "styret samlet", roles=(("A", 2), ("B", 1))),
        member(6, "samlet styret"),
        member(7, "styret samlet", form=None),
        member(8, "styret samlet", form=None),
        member(10, None, None, None),
        member(11, "", "--", ()),
        member(12, "styret samlet", text=False),
        member(None, "styret samlet"),
        member(13, "x" * 50000),
        member(14, "X" * 50000),
    ]
    got = {r.member_id: (r.first_id, r.n_copies) for r in refine.member_copies(spark.createDataFrame(rows, MEMBER)).collect()}
    assert got == {3: (3, 3), 5: (3, 3), 9: (3, 3), 7: (7, 2), 8: (7, 2), 10: (10, 2), 11: (10, 2), 13: (13, 2), 14: (13, 2)}
    assert refine.member_copies(spark.createDataFrame(rows, MEMBER).limit(0)).count() == 0


GOLD = "seq bigint, item_id string, annotator string, skipped boolean, rule_type string, min_signers string, ambiguity int, label string"


def vote(seq, item, who, rule, signers=None, amb=None, skipped=False):
    return (seq, item, who, skipped, rule, signers, amb, "clash")


def test_plurality_spellings_skips_and_ties(spark):
    rows = [
        vote(1, "i", "ann-01", "sole ceo", "3 +", 9),
        vote(2, "i", "ANN_01 ", " Sole-CEO", "3+ ", 2),  # replaces seq 1
        vote(2, "i", "ANN_01 ", " Sole-CEO", "3+ ", 2),  # repeated row
        vote(3, "i", "ann-02", "sole_ceo", "ALL board", 2),
        vote(4, "i", "ann-03", "sole_chair", None, 1),
        vote(5, "tie", "ann-01", "sole_ceo"),
        vote(6, "tie", "ann-02", "sole_chair"),
        vote(7, "one", "ann-01", "sole_ceo"),
        vote(8, "skip", "ann-01", "sole_ceo"),
        vote(9, "skip", "ann-02", "sole_ceo"),
        vote(10, "skip", "ann-02", "sole_ceo", skipped=True),
        vote(None, None, "ann-01", "sole_ceo"),
        vote(11, "null", None, "sole_ceo"),
    ]
    df = spark.createDataFrame(rows, GOLD)
    items, trust = consensus.consensus(df)
    got = {(r.item_id, r.question): (r.label, r.n_votes) for r in items.collect()}
    assert got == {("i", "rule_type"): ("sole_ceo", 3), ("i", "min_signers"): (None, 2), ("i", "ambiguity"): ("2", 3), ("tie", "rule_type"): (None, 2), ("one", "rule_type"): (None, 1), ("skip", "rule_type"): (None, 1)}
    assert {r.annotator for r in trust.collect()} == {"ann_01", "ann_02", "ann_03"}
    items, trust = consensus.consensus(df.limit(0))
    assert items.count() == trust.count() == 0


def test_reliability_orders_annotators(spark):
    import random

    rng = random.Random(2)
    rows, seq = [], 0
    for i in range(80):
        truth = rng.choice("012")
        for who, p in (("good", 0.95), ("fair", 0.8), ("other", 0.8), ("poor", 0.34)):
            seq += 1
            label = truth if rng.random() < p else rng.choice([x for x in "012" if x != truth])
            rows.append(vote(seq, f"i{i}", who, None, None, int(label)))
    _, trust = consensus.consensus(spark.createDataFrame(rows, GOLD))
    r = {x.annotator: x.reliability for x in trust.collect()}
    assert r["good"] > r["fair"] > r["poor"] and r["good"] > r["other"] > r["poor"]


def test_tie_is_broken_by_reliability_in_scored_label(spark):
    rows, seq = [], 0
    for i in range(30):
        for who, label in (("a", 1), ("b", 1), ("c", 1), ("bad", i % 4)):
            seq += 1
            rows.append(vote(seq, f"i{i}", who, None, None, label))
    rows += [vote(900, "t", "a", None, None, 1), vote(901, "t", "bad", None, None, 3)]
    items, _ = consensus.consensus(spark.createDataFrame(rows, GOLD))
    t = items.where("item_id = 't'").first()
    assert (t.label, t.scored_label) == (None, "1")
