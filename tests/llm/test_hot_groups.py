"""A third of all rows in one group, with a single broadcast key, so that both ways of the skewed join are taken."""

import pytest

from quillstone.llm import cosine, refine, splits
from quillstone.operators import skew


@pytest.fixture(autouse=True)
def few_hot_keys(monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 1)


def text(i):
    return "ett og samme vedtak om fullmakt" if i % 3 == 0 else f"vedtak nummer {i // 6} om fullmakt for avdeling {i // 6}"


N = 600


def test_copies(spark):
    rows = [(i, "NO", text(i), None, True, (("AS", []),)) for i in range(N)]
    df = spark.createDataFrame(rows, "member_id bigint, jurisdiction string, signature_key string, procuration_key string, has_text boolean, request struct<state struct<legal_form string, roles array<struct<role string, count int>>>>")
    groups = {}
    for i in range(N):
        groups.setdefault(text(i), []).append(i)
    want = {i: (min(g), len(g)) for g in groups.values() if len(g) > 1 for i in g}
    assert {r.member_id: (r.first_id, r.n_copies) for r in refine.member_copies(df).collect()} == want


def test_overlaps(spark):
    rows = [(i, "train" if i % 2 else "test", "NO", "1" if i % 3 == 0 else str(1000 + i), True, text(i), None) for i in range(N)]
    df = spark.createDataFrame(rows, "member_id bigint, part_name string, jurisdiction string, entity_id string, has_text boolean, signature_key string, procuration_key string")
    got = {(r.member_id, r.kind) for r in cosine.overlaps(df).collect()}
    train = {text(i) for i in range(1, N, 2)}
    assert {m for m, k in got if k == "entity"} == {i for i in range(0, N, 6)}
    assert {m for m, k in got if k == "exact"} == {i for i in range(0, N, 2) if text(i) in train}


def test_components(spark):
    m = [(i, f"r{i}", "NO", "1" if i % 3 == 0 else None, f"c{i // 2}" if i % 3 else None, True) for i in range(N)]
    df = spark.createDataFrame(m, "member_id bigint, rid string, jurisdiction string, entity_id string, cluster string, has_text boolean")
    items = spark.createDataFrame([("r1", "g"), ("r599", "g")], "rid string, grp string")
    got = {r.member_id: r for r in splits.split_members(df, items).collect()}
    assert len(got) == N and {got[i].root_id for i in range(0, N, 3)} == {0} and got[599].root_id == 1
    assert len({got[i].split for i in range(0, N, 3)}) == 1
