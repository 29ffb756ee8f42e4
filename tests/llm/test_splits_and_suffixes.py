import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import splits, suffixes


def test_anneal_reaches_shares():
    rng = np.random.default_rng(0)
    size = np.stack([rng.integers(1, 30, 400), rng.integers(0, 10, 400)], axis=1).astype(float)
    counts = rng.multinomial(5, [0.8, 0.1, 0.1], 400)
    target = np.array([0.8, 0.1, 0.1])[:, None] * (counts.sum(axis=1) @ size)
    cost, now = splits.anneal(size, counts, target, 3, 1000)
    assert (now.sum(axis=1) == 5).all() and (now >= 0).all()
    assert cost < 1e-7 and np.abs(now.T @ size - target).max() < 0.001 * target.sum()


MEMBER = "member_id bigint, rid string, jurisdiction string, entity_id string, cluster string, has_text boolean, key string"


def test_members_stay_together(spark):
    m = [(i, f"r{i}", "NO", None, None, True, "x") for i in range(1, 400)]
    m[0] = (1, "r1", "NO", "100", "", True, "x")
    m[1] = (2, "r2", "NO", "NO 100 MVA", "c", True, "x")
    m[2] = (3, "r3", "AT", "100", "c", False, "x")  # by cluster
    m[3] = (4, "r4", "DK", "7", None, None, "x")  # by item group with 3
    m[4] = (5, "r5", None, "100", "", True, "x")  # no jurisdiction: no company
    items = spark.createDataFrame([("r3", "g"), ("r4", "g"), ("r4", "g"), ("r9", None), ("none", "g"), (None, "g")], "rid string, grp string")
    df = spark.createDataFrame(m, MEMBER)
    got = {r.member_id: (r.root_id, r.split) for r in splits.split_members(df, items).collect()}
    assert len(got) == 399 and {got[i] for i in (1, 2, 3, 4)} == {got[1]} and got[1][0] == 1 and got[5][0] == 5
    n = [sum(s == name for _, s in got.values()) for name, _ in splits.SHARES]
    assert abs(n[0] - 0.8 * 399) < 4 and abs(n[1] - 39.9) < 4
    assert splits.split_members(df.limit(0), items.limit(0)).count() == 0


def test_one_component_with_a_third_and_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(splits, "KINDS", 7)
    monkeypatch.setattr(splits, "BUCKET", 16)
    df = spark.range(1000).selectExpr("id as root_id", "cast(if(id = 0, 2500, 1 + pmod(hash(id), 9)) as bigint) as n", "cast(pmod(hash(id, 3), 2) as bigint) as k")
    got = splits.assign(df, ["n", "k"]).join(df, "root_id").groupBy("split").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()
    whole = sum(r.n for r in got)
    assert sum(r.c for r in got) == 1000
    assert all(abs(r.n / whole - dict(splits.SHARES)[r.split]) < 0.02 for r in got)


def brute(docs, items, n):
    def runs(t):
        w = suffixes.words(t)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    d, i = [(k, runs(t)) for k, t in docs], [(k, runs(t)) for k, t in items]
    return {(x, y) for x, a in d for y, b in i if a & b}


def test_equals_brute_force_in_small_shards_and_blocks(spark, monkeypatch):
    import random

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(0, 9))) for i in range(30)] + [(30, None), (31, "")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(80)] + [(80, None), (81, ""), (82, items[0][1]), (82, items[0][1]), (83, "w1 " * 3000)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(suffixes, "SHARD_WORDS", 100)
    monkeypatch.setattr(suffixes, "BLOCK_CHARS", 400)
    got = {(r.doc_id, r.item_id) for r in suffixes.leaks(d, i, least=4).collect()}
    want = brute(docs, items, 4)
    assert got == want and want
    assert suffixes.leaks(d.limit(0), i).count() == suffixes.leaks(d, i.limit(0)).count() == 0
    kept = suffixes.without_leaks(d, suffixes.leaks(d, i, least=4))
    assert kept.where("doc_id = 82").count() == 0 or (82, 0) not in want


def test_longest_match_and_place(spark):
    item = "en to tre fire fem seks sju åtte ni ti elleve tolv tretten fjorten"
    doc = "Først: EN, to\ntre fire fem seks sju åtte ni ti elleve tolv tretten slutt. en to"
    d = spark.createDataFrame([(1, doc, "x"), (2, "to " + item.replace("seks", "6"), "x")], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(9, item)], "item_id bigint, text string")
    assert [tuple(r) for r in suffixes.leaks(d, i).collect()] == [(1, 9, 13, 1, 0)]


def test_memory_and_time_of_a_long_held_out_text():
    rng = np.random.default_rng(1)
    long = [f"w{i}" for i in rng.integers(0, 50, 50_000)]
    held = suffixes.HeldOut([(1, " ".join(long)), (2, "x " * 20_000)], 12)
    docs = [(10, ["other", *long[5_000:45_000], "other"]), (11, long[:11]), (12, ["x"] * 500), (13, long[100:112] + ["other"] + long[90:120])]
    got = {(a, b): (n, d, i) for a, b, n, d, i in suffixes.search_shard(docs, held).tolist()}
    assert got == {(10, 1): (40_000, 1, 5_000), (12, 2): (500, 0, 0), (13, 1): (30, 13, 90)}
    assert held.flat.nbytes + held.start.nbytes + held.hash.nbytes < 3_000_000
