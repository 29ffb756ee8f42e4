"""Overlaps between splits: shared entities, equal texts, near-equal texts.

Near-equal texts come from a weighted cosine join of inverted lists. A text is the vector of its characters'
trigrams, each weighing by its rarity (the logarithm of its document frequency). A(a), B(b) with
|A ∩ B| >= t |A ∪ B| differ in at most (a + b) (1 - t) / (1 + t) trigrams; t is a parameter, 0.8 or more.

Terms. Trigrams alone are too common to be selective: their number doesn't grow with the corpus. So the
trigrams of a text are spread over k blocks by their hash, k a third of the size class of the text, and
what a block holds is a term: (class, block, its trigrams). A differing trigram changes one term, so
that similar texts differ in d <= n (1 - t) / t terms, n being the number of trigrams. A term weighs as much as its
trigrams together.

Residual-norm pruning. Each text lists only its d + 1 heaviest terms: if it has more than d terms, the
first common term of two similar texts, by weight, is among these on both sides, as the residual, the
terms not listed, can't make up the similarity alone. A text with too few terms for that lists its d + 1
heaviest plain trigrams as well.

Maximum-weight pruning. A text looks only into the lists of its own and the neighbouring size classes, as sizes of
similar texts differ by a factor of 1 / t at most; and each entry of a list carries the parity of its
trigrams in 256 bits, whose distance bounds the difference of two texts from below, so that hardly any
pair leaves the join that isn't similar.

What is left gets its exact products: the weighted dot product and cosine, and the number of common trigrams,
which decides against t.

Disk. A text and its keys are one row until just before the join, which takes the keys in passes by their hash: a pass
shuffles about ENTRIES entries of the base, or a MOST_PASSES-th of them if there are more, and its shuffle is given up
before the next. Hot lists are found by counts within partitions, without a shuffle of the keys.

Hot lists. A term that more than LIST texts of the base have is a list in parts. Every text looks into the first
part; only those that found nothing similar there go through the others, in as many tasks as there are parts. For a
text that only has to find one similar one (`nearest`), the candidate of least distance is tested first, and the others
only if it fails. So a third of all texts being near-copies of each other costs one test a text, and nothing is lost.

Texts are reduced to distinct ones before the join, and results return to the members, by a hash of 128 bits, through
joins that split hot keys. Nothing is gathered on the driver but the document frequencies of at most MOST_TERMS
trigrams, which only order terms and weigh (others count as rarest, so that no pair depends on it). The MOST_HOT longest lists are
broadcast with their parts; a further one would be searched whole.

Defined cases: null texts are read as ''; members without text have no exact or near overlap; a null or
digitless entity_id is no entity; repeated rows of one member give one row; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import register_number, words_joined
from ..operators.skew import lookup_join
from ..session import cut, release

MOST_TERMS = 1 << 20
#: Least overlap, as a fraction.
LEAST = (4, 5)
#: Entries of one part of an inverted list, on average at most.
LIST = 10_000
#: Lists in parts whose keys are broadcast; all entries together make 2 / LIST times as many at most.
MOST_HOT = 1 << 17
#: Entries of the base in one pass of the join, and the number of passes beyond which they hold more.
ENTRIES, MOST_PASSES = 8_000_000, 8
#: Similar sizes differ by at most 1 / 0.8; classes grow a little faster, so that similar texts are in neighbouring ones.
GROWTH = 1.26
_BOUNDS = np.unique(np.floor(GROWTH ** np.arange(0, 110)))
_BITS = 256


def trigrams(text: str) -> np.ndarray:
    """The distinct trigrams of the padded text, each as one number, sorted."""
    c = np.frombuffer(f"  {text}  ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.unique((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _parity(mixed: np.ndarray) -> np.ndarray:
    """Four words of parity bits."""
    bits = np.bincount((mixed >> np.uint64(20)).astype(np.int64) & (_BITS - 1), minlength=_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


class Lister:
    """Lists terms of texts, the rarest first."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, least: tuple[int, int] = LEAST) -> None:
        self.least = least
        order = np.argsort(terms)
        self.terms, self.rarity = terms[order], np.log(np.maximum(counts[order], 1).astype(np.float64)) - np.log(float(counts.max(initial=1)) + 1)
        self.rarest = -np.log(float(counts.max(initial=1)) + 1)

    def weights(self, grams: np.ndarray) -> np.ndarray:
        """Log document frequency of each trigram, relative to the most frequent one; always negative."""
        if not len(self.terms):
            return np.full(len(grams), -1.0)
        at = np.minimum(np.searchsorted(self.terms, grams), len(self.terms) - 1)
        return np.where(self.terms[at] == grams, self.rarity[at], self.rarest)

    def list(self, grams: np.ndarray, mixed: np.ndarray, classes: Iterable[int]) -> list[np.ndarray]:
        """Keys under which the text is listed, for each of the size classes."""
        n = len(grams)
        d = n * (self.least[1] - self.least[0]) // self.least[0]
        w = self.weights(grams)
        out = []
        thin = False
        for c in classes:
            k = np.uint64(max(32, int(np.ceil(GROWTH ** (c + 0.5) / 3))))
            block = (mixed % k).astype(np.int64)
            order = np.argsort(block, kind="stable")
            b = block[order]
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            weight = np.add.reduceat(w[order], first)
            held = np.add.reduceat(_mix(mixed[order] + np.uint64(c)), first)
            key = _mix(held ^ (b[first].astype(np.uint64) << np.uint64(32)) ^ np.uint64(c))
            thin |= len(first) <= d
            rare = np.lexsort((key, np.round(weight, 9)))[: d + 1]
            out.append(key[rare])
        if thin:
            rare = np.lexsort((grams, np.round(w, 9)))[: d + 1]
            out.append(_mix(mixed[rare] ^ np.uint64(0x5EED)))
        return out


def size_class(n: int) -> int:
    return int(np.searchsorted(_BOUNDS, n, "right"))


_LISTED = pa.schema([("id", pa.int64()), ("n", pa.int32()), *[(f"b{i}", pa.int64()) for i in range(4)], ("keys", pa.list_(pa.int64()))])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams and the number of texts that have each; of the MOST_TERMS most frequent ones."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = [trigrams(t) for t in batch.column(0).to_pylist()]
            grams, n = np.unique(np.concatenate(all_), return_counts=True) if all_ else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    counts = texts.select("text").mapInArrow(scan, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in batch.columns], names=["grams", "n"])

    # Packed before they come to the driver, 16 bytes each: as rows, they would be sorted there, and be several hundred bytes each.
    most = counts.orderBy(F.desc("n"), "gram").limit(MOST_TERMS).select("gram", "n")
    got = most.mapInArrow(packed, "grams binary, n binary").collect()
    grams, n = (np.frombuffer(b"".join(r[i] for r in got), np.int64) for i in (0, 1))
    return grams.view(np.uint64), n


def listed(texts: DataFrame, frequencies: object, around: bool, least: tuple[int, int]) -> DataFrame:
    """(id, n, b0..b3, keys) of each text: the keys of its inverted lists; `around`: also those of the neighbouring size classes."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lister = Lister(*frequencies.value, least)
        for batch in batches:
            keys, ns, parities = [], [], []
            for text in batch.column(1).to_pylist():
                grams = trigrams(text)
                mixed = _mix(grams)
                c = size_class(len(grams))
                keys.append(np.concatenate(lister.list(grams, mixed, (c - 1, c, c + 1) if around else (c,))))
                ns.append(len(grams))
                parities.append(_parity(mixed))
            if keys:
                p, ends = np.stack(parities), np.cumsum([0, *map(len, keys)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
                cols = [batch.column(0), pa.array(ns, pa.int32()), *[pa.array(np.ascontiguousarray(p[:, i])) for i in range(4)], lists]
                yield pa.RecordBatch.from_arrays(cols, schema=_LISTED)

    return texts.select("id", "text").mapInArrow(scan, "id bigint, n int, b0 bigint, b1 bigint, b2 bigint, b3 bigint, keys array<bigint>")


def _hot(b: DataFrame) -> DataFrame:
    """(key, parts) of the lists that may have more than LIST entries. Each partition gives the keys that it has more often than
    LIST / 2 over the number of partitions, so that their sum is less than LIST / 2 short of the entries of a list: lists that aren't
    given have LIST entries at most, and so have the parts of those that are."""
    often = LIST / 2 / max(1, b.rdd.getNumPartitions())

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate([np.empty(0, np.int64), *[x.column(0).flatten().to_numpy(zero_copy_only=False) for x in batches]]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys[n > often], pa.int64()), pa.array(n[n > often], pa.int64())], names=["key", "n"])

    sums = b.select("keys").mapInArrow(scan, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > LIST / 2)
    return cut(sums.orderBy(F.desc("n"), "key").limit(MOST_HOT).select("key", (1 + F.col("n") * 2 / LIST).cast("int").alias("parts")))


def _checked(least: tuple[int, int]) -> tuple[int, int]:
    if not least[1] <= GROWTH * least[0]:
        raise ValueError("size classes hold for an overlap of 0.8 or more")
    return least


def _lists(queries: DataFrame, base: DataFrame, frequencies: object, least: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts of both sides with their keys, and the hot keys (key, parts)."""
    q, b = cut(listed(queries, frequencies, True, least)), cut(listed(base, frequencies, False, least))
    return q, b, _hot(b)


def _entries(lists: DataFrame, hot: DataFrame, how: str, passes: int = 1, at: int = 0) -> DataFrame:
    """Entries (key, id, n, b0..b3, parts) of those keys that are the turn of the pass `at`; parts of hot keys alone; how: left or inner."""
    keys = F.filter("keys", lambda k: F.pmod(F.shiftright(k, 8), F.lit(passes)) == at) if passes > 1 else F.col("keys")
    return lists.select(F.explode(keys).alias("key"), "id", "n", *[f"b{i}" for i in range(4)]).join(F.broadcast(hot), "key", how)


def _pairs(q: DataFrame, b: DataFrame, on: list[str], least: tuple[int, int]) -> DataFrame:
    """(id, base_id, apart) of entries of the same list that the bounds on size and distance let through."""
    q, b = q.alias("q"), b.alias("b")
    apart = sum((F.bit_count(F.col(f"q.b{i}").bitwiseXOR(F.col(f"b.b{i}"))) for i in range(1, 4)), F.bit_count(F.col("q.b0").bitwiseXOR(F.col("b.b0"))))
    n, m = F.col("q.n").cast("bigint"), F.col("b.n").cast("bigint")
    t, u = least
    close = (u * F.least(n, m) >= t * F.greatest(n, m)) & ((u + t) * apart <= (u - t) * (n + m))
    for c in on:
        close = close & (F.col(f"q.{c}") == F.col(f"b.{c}"))
    return q.join(b, close).select(F.col("q.id").alias("id"), F.col("b.id").alias("base_id"), apart.alias("apart")).distinct()


def _part() -> Column:
    return F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(0).cast("int")


def _first(q: DataFrame, b: DataFrame, hot: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs with the first part of every list, in passes over the keys."""
    entries = b.agg(F.sum(F.size("keys"))).first()[0] or 0
    passes = min(MOST_PASSES, 1 + entries // ENTRIES)
    found = None
    for at in range(passes):
        mine = _entries(b, hot, "left", passes, at).where(_part() == 0).drop("parts")
        pairs = cut(_pairs(_entries(q, hot, "left", passes, at).drop("parts"), mine, ["key"], least))
        release(pairs.sparkSession)
        found = pairs if found is None else found.unionAll(pairs)
    return found.distinct() if passes > 1 else found


def _further(q: DataFrame, b: DataFrame, hot: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs with the parts of hot lists after the first."""
    looking = _entries(q, hot, "inner").withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts") - 1))).drop("parts")
    return _pairs(looking, _entries(b, hot, "inner").withColumn("part", _part()).where("part > 0").drop("parts"), ["key", "part"], least)


def _tested(pairs: DataFrame, queries: DataFrame, base: DataFrame, frequencies: object, least: tuple[int, int]) -> DataFrame:
    """(id, base_id, similarity, cosine) of the pairs that have at least `least` of their trigrams in common: the exact products."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lister = Lister(*frequencies.value, least)
        for batch in batches:
            kept, similarity, cosine = [], [], []
            for row, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                a, b = trigrams(x), trigrams(y)
                both = np.intersect1d(a, b, assume_unique=True)
                union = len(a) + len(b) - len(both)
                if least[1] * len(both) >= least[0] * union:
                    square = lambda g: float((lister.weights(g) ** 2).sum())
                    kept.append(row)
                    similarity.append(len(both) / union)
                    cosine.append(square(both) / max((square(a) * square(b)) ** 0.5, 1e-300))
            ids = [batch.column(i).take(pa.array(kept, pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(similarity, pa.float64()), pa.array(cosine, pa.float64())], names=["id", "base_id", "similarity", "cosine"])

    whole = pairs.select("id", "base_id").join(queries.select("id", F.col("text").alias("_a")), "id").join(base.select(F.col("id").alias("base_id"), F.col("text").alias("_b")), "base_id")
    return whole.select("id", "base_id", "_a", "_b").mapInArrow(scan, "id bigint, base_id bigint, similarity double, cosine double")


def _frequencies(queries: DataFrame, base: DataFrame) -> object:
    return queries.sparkSession.sparkContext.broadcast(document_frequencies(queries.select("text").unionAll(base.select("text"))))


def near(queries: DataFrame, base: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """(id, base_id, similarity, cosine) of all texts of `queries` and of `base` (both: id bigint, text string, texts
    distinct, id a 64-bit hash) of whose trigrams at least `least` are in common."""
    frequencies = _frequencies(queries, base)
    q, b, hot = _lists(queries, base, frequencies, _checked(least))
    pairs = _first(q, b, hot, least)
    if not hot.isEmpty():
        pairs = pairs.unionAll(_further(q, b, hot, least)).distinct()
    return _tested(pairs, queries, base, frequencies, least)


def nearest(queries: DataFrame, base: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """(id, similarity, cosine): as `near`, but one row for each text of `queries` that has any similar one."""
    frequencies = _frequencies(queries, base)
    q, b, hot = _lists(queries, base, frequencies, _checked(least))
    best = F.max(F.struct("similarity", "cosine")).alias("s")

    def one(pairs: DataFrame) -> DataFrame:
        rows = cut(_tested(pairs, queries, base, frequencies, least).groupBy("id").agg(best).select("id", "s.*"))
        release(rows.sparkSession)
        return rows

    pairs = _first(q, b, hot, least)
    firsts = pairs.groupBy("id").agg(F.min(F.struct("apart", "base_id")).alias("f")).select("id", F.col("f.base_id").alias("base_id"))
    found = one(firsts)
    others = pairs.join(found.select("id"), "id", "left_anti").join(firsts, ["id", "base_id"], "left_anti")
    found = found.unionAll(one(others))
    if hot.isEmpty():
        return found
    more = _further(q.join(found.select("id"), "id", "left_anti"), b, hot, least)
    return found.unionAll(one(more))


def overlaps(members: DataFrame, train: str = "train") -> DataFrame:
    """(member_id, kind) of every member of another part than `train`, kind being entity, exact or near."""
    m = members.select(
        F.col("member_id").cast("bigint").alias("member_id"),
        (F.col("part_name") == train).alias("is_train"),
        F.concat_ws("|", "jurisdiction", register_number(F.col("jurisdiction"), F.col("entity_id"))).alias("entity"),
        register_number(F.col("jurisdiction"), F.col("entity_id")).isNotNull().alias("has_entity"),
        F.coalesce("has_text", F.lit(False)).alias("has_text"),
        F.concat_ws("|", words_joined("signature_key"), words_joined("procuration_key")).alias("text"),
    ).where("member_id is not null and is_train is not null")
    sides = [F.max("is_train").alias("in_train"), F.count_if(~F.col("is_train")).alias("n")]

    entities = m.where("has_entity").groupBy("entity").agg(*sides).where("in_train and n > 0").withColumn("hit", F.lit(True))
    by_entity = lookup_join(m.where("has_entity and not is_train").select("member_id", "entity"), entities, "entity", "n", "hit")

    texts = cut(m.where("has_text").groupBy("text").agg(*sides).select(F.md5("text").alias("h"), F.xxhash64("text").alias("id"), "text", "in_train", "n"))
    base, queries = texts.where("in_train"), texts.where("not in_train and n > 0")
    alike = nearest(queries, base).select("id")
    kinds = texts.where("in_train and n > 0").select("h", "n", F.lit("exact").alias("kind")).unionAll(queries.join(alike, "id").select("h", "n", F.lit("near").alias("kind")))
    asked = cut(m.where("has_text and not is_train").select("member_id", F.md5("text").alias("h")))
    by_text = lookup_join(asked, cut(kinds), "h", "n", "kind")
    return by_entity.select("member_id", F.lit("entity").alias("kind")).unionAll(by_text.select("member_id", "kind")).distinct()


def near_rate(members: DataFrame, least: tuple[int, int] = (19, 20), train: str = "train", part: str = "test") -> DataFrame:
    """(n_texts, n_near, near_dup_rate): of the distinct texts that stand only in `part`, those with a similar text in `train`."""
    text = F.concat_ws("|", words_joined("signature_key"), words_joined("procuration_key"))
    where = members.where("has_text and part_name is not null").select(text.alias("text"), "part_name").groupBy("text")
    texts = where.agg(F.max(F.col("part_name") == train).alias("in_train"), F.min(F.col("part_name") == part).alias("only"))
    texts = cut(texts.where("in_train or only").select(F.xxhash64("text").alias("id"), "text", "in_train", "only"))
    alone = texts.where("only")
    found = nearest(alone, texts.where("in_train"), least)
    counts = alone.agg(F.count("*").alias("n_texts")).crossJoin(found.agg(F.count("*").alias("n_near")))  # one row each
    return counts.select("n_texts", "n_near", F.round(F.coalesce(F.try_divide("n_near", "n_texts"), F.lit(0.0)), 6).alias("near_dup_rate"))


def report(members: DataFrame, found: DataFrame) -> DataFrame:
    """(part_name, jurisdiction, n_members, entity_overlap, exact_text_overlap, near_dups, near_dup_rate):
    counts by split and source; the rate is over members with text that have no exact overlap."""
    flags = found.groupBy("member_id").agg(*[F.max(F.col("kind") == k).alias(k) for k in ("entity", "exact", "near")])
    rows = members.where("part_name <> 'train'").select("member_id", "part_name", "jurisdiction", "has_text").join(flags, "member_id", "left")
    text = F.count_if(F.col("has_text") & ~F.coalesce("exact", F.lit(False)))
    return rows.groupBy("part_name", "jurisdiction").agg(
        F.count("*").alias("n_members"),
        F.count_if("entity").alias("entity_overlap"),
        F.count_if("exact").alias("exact_text_overlap"),
        F.count_if("near").alias("near_dups"),
        F.round(F.try_divide(F.count_if("near"), text), 6).alias("near_dup_rate"),
    )
