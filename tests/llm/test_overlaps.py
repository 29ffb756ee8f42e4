import random

from quillstone.llm import cosine

COLUMNS = "member_id bigint, part_name string, jurisdiction string, entity_id string, has_text boolean, signature_key string, procuration_key string, kind string"


def members(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], COLUMNS)


def found(df):
    return {(r.member_id, r.kind) for r in cosine.overlaps(df).collect()}


def grams(t):
    t = f"  {t}  "
    return {t[i : i + 3] for i in range(len(t) - 2)}


def test_kinds_nulls_and_repeats(spark):
    long = "styrets leder og to medlemmer undertegner i fellesskap ved salg av eiendom"
    rows = [
        (1, "train", "NO", "201 020 964", True, long, None),
        (2, "test", "NO", "NO201020964MVA", False, long, None),  # entity only: no text
        (3, "val", "AT", "201020964", True, long.upper() + ".", ""),  # exact; another jurisdiction
        (4, "val", "NO", None, True, long + " x", None),  # near
        (5, "val", "NO", "ukjent", True, "helt annen tekst", None),
        (6, "train", "NO", "ukjent", None, long, None),
        (7, None, "NO", "201020964", True, long, None),
        (4, "val", "NO", None, True, long + " x", None),
        (8, "test", None, "1", True, None, None),
    ]
    assert found(members(spark, rows)) == {(2, "entity"), (3, "exact"), (4, "near")}
    assert found(members(spark, rows[:1])) == set()
    assert found(members(spark, rows).limit(0)) == set()


def test_near_equals_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeikloprst") for _ in range(rng.randint(2, 7)))
    texts = {" ".join(word() for _ in range(rng.choice([1, 2, 5, 30, 200]))) for _ in range(120)}
    for t in sorted(texts):
        for _ in range(3):
            c = list(t)
            for _ in range(rng.randint(1, max(1, len(c) // 12))):
                c[rng.randrange(len(c))] = rng.choice("abcxyz ")
            texts.add(" ".join("".join(c).split()))
    texts = sorted(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")
    q, b = df.where("id % 3 = 0"), df.where("id % 3 <> 0")
    g = [grams(t) for t in texts]
    for least in ((4, 5), (19, 20)):
        got = {(r.id, r.base_id): r for r in cosine.near(q, b, least).collect()}
        want = {(i, j) for i in range(0, len(g), 3) for j in range(len(g)) if j % 3 and least[1] * len(g[i] & g[j]) >= least[0] * len(g[i] | g[j])}
        assert set(got) == want and len(want) > 5 and all(0 < r.cosine <= 1 + 1e-9 for r in got.values())


def test_hot_lists_in_parts_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(cosine, "LIST", 5)
    rng = random.Random(4)
    stock = "styrets leder og to medlemmer i fellesskap undertegner avtale nummer "
    texts = sorted({stock + "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([3, 12, 25]))).strip() for _ in range(150)})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")
    q, b = df.where("id % 3 = 0"), df.where("id % 3 <> 0")
    g = [grams(t) for t in texts]
    want = {(i, j) for i in range(0, len(g), 3) for j in range(len(g)) if j % 3 and 5 * len(g[i] & g[j]) >= 4 * len(g[i] | g[j])}
    assert {(r.id, r.base_id) for r in cosine.near(q, b).collect()} == want and want
    assert {r.id for r in cosine.nearest(q, b).collect()} == {i for i, _ in want}


def test_passes_lose_nothing_and_checkpoints_hold_a_row_a_text(spark, monkeypatch):
    monkeypatch.setattr(cosine, "ENTRIES", 700)
    rows, cut = [], cosine.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(cosine, "cut", counted)
    rng = random.Random(7)
    texts = sorted({"fullmakt " + "".join(rng.choice("abcdefghij ") for _ in range(60)).strip() for _ in range(60)})
    texts = sorted({*texts, *(t + " x" for t in texts[::2])})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")
    q, b = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    g = [grams(t) for t in texts]
    want = {i for i in range(0, len(g), 2) if any(5 * len(g[i] & g[j]) >= 4 * len(g[i] | g[j]) for j in range(1, len(g), 2))}
    assert {r.id for r in cosine.nearest(q, b).collect()} == want and want
    assert len(rows) > 5 and max(rows) <= len(texts)


def test_frequencies_come_to_the_driver_packed(spark, monkeypatch):
    def rows(df):
        raise AssertionError("one row a trigram on the driver")

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toPandas", rows)
    terms, n = cosine.document_frequencies(spark.createDataFrame([("abab",), ("abc",)], "text string"))
    got = {int(t): int(k) for t, k in zip(terms, n)}
    want = [x for t in ("abab", "abc") for x in cosine.trigrams(t).tolist()]
    assert got == {t: want.count(t) for t in want} and list(n) == sorted(n, reverse=True)


def test_report(spark):
    df = members(spark, [(1, "train", "NO", "1", True, "abc def", None), (2, "val", "NO", "1", True, "ABC def", None), (3, "val", "NO", "2", True, "zzz", None)])
    r = cosine.report(df, cosine.overlaps(df)).collect()
    assert [tuple(x) for x in r] == [("val", "NO", 2, 1, 1, 0, 0.0)]
