"""Passages of held-out texts inside a training corpus, found with suffix arrays of corpus shards.

A shard is a run of training rows with at most SHARD_WORDS words (one row at least). Words are numbered
by the vocabulary of the held-out texts; any other word can't be part of a match and ends it. Hashes of the
runs of `least` words rule out the places of the shard that can't begin a match; the suffix array of the shard
holds the places of all others, sorted by the `least` words that follow. Every suffix of every held-out text is
binary-searched, all at once, for the range of training suffixes that begin with its first `least` words. A hit
that goes on to the left belongs to a longer one; all others are followed word by word, together, to their longest
verbatim match. Memory is in proportion to the words of a shard and of a block, however long a text or a match is.

The corpus is read once and never shuffled; only hits are. Held-out texts travel to the workers in blocks of at
most BLOCK_CHARS characters (a longer text is a block), one of which is in a worker's memory at a time.

Defined cases: null and empty texts have no words and no matches; held-out texts with fewer than `least` words
can't match; texts of any length are searched whole;
a document that repeats a passage is one row with its longest match; rows repeated with one doc_id are
one document; null ids are skipped; empty tables give empty ones; other columns aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

SHARD_WORDS = 2_000_000
BLOCK_CHARS = 32 << 20
LEAST_WORDS = 12


_MIX = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(flat: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """A hash of the `least` words from each start on."""
    h = np.zeros(len(starts), np.uint64)
    for k in range(least):
        h = (h ^ (flat[starts + k].astype(np.uint64) + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(29)
    return h


class HeldOut:
    """Numbered words of a block of held-out texts, one text after another (-1 before and after each), and its suffixes."""

    def __init__(self, items: list[tuple[int, str | None]], least: int) -> None:
        self.least = least
        self.number: dict[str, int] = {}
        flat, starts, owner = [np.array([-1], np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        at = 1
        for item, text in items:
            ws = words(text)
            if len(ws) < least:
                continue
            flat.append(np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in ws), np.int32, len(ws)))
            flat.append(np.array([-1], np.int32))
            starts.append(at + np.arange(len(ws) - least + 1))
            owner.append(np.full(len(ws) - least + 1, item, np.int64))
            at += len(ws) + 1
        self.flat, self.start, self.item = np.concatenate(flat), np.concatenate(starts), np.concatenate(owner)
        self.begin = np.concatenate([[0], np.flatnonzero(self.flat == -1)[:-1] + 1]) if len(self.flat) > 1 else np.zeros(1, np.int64)
        self.hash = run_hashes(self.flat, self.start, least)
        self.hashes = np.unique(self.hash)


def _among(sorted_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key is one of the sorted values."""
    if not len(sorted_):
        return np.zeros(len(keys), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)] == keys


def _bound(array: np.ndarray, keys: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all rows of `keys` in the sorted rows of `array`."""
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(array), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        differs = array[mid] - keys[open_]
        first = (differs != 0).argmax(axis=1)
        sign = np.sign(differs[np.arange(len(open_)), first])
        right = sign <= 0 if upper else sign < 0
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]
    return low


_NO_HITS = np.empty((0, 5), np.int64)
_PAIRS = 1 << 20


def search_shard(docs: list[tuple[int, list[str]]], held: HeldOut) -> np.ndarray:
    """Rows (doc, item, words of the longest match, its first word in the document, in the item)."""
    least, get = held.least, held.number.get
    lengths = np.fromiter((len(w) + 1 for _, w in docs), np.int64, len(docs))
    offsets = np.concatenate([[1], 1 + np.cumsum(lengths)])
    flat = np.zeros(int(offsets[-1]) + least, np.int32)  # a 0 before and after each document and for strange words
    for at, (_, ws) in zip(offsets.tolist(), docs):
        flat[at : at + len(ws)] = np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws))
    strange = np.concatenate([[0], np.cumsum(flat == 0)])
    places = np.flatnonzero(strange[least:] - strange[:-least] == 0)
    hashes = run_hashes(flat, places, least)
    may = _among(held.hashes, hashes)
    places, hashes = places[may], np.unique(hashes[may])
    if not len(places):
        return _NO_HITS
    # The suffix array: places sorted by the words that follow.
    rows = flat[places[:, None] + np.arange(least)]
    order = np.lexsort(rows.T[::-1])
    places, rows = places[order], rows[order]
    suffix = np.flatnonzero(_among(hashes, held.hash))
    keys = held.flat[held.start[suffix][:, None] + np.arange(least)]
    low, high = _bound(rows, keys, False), _bound(rows, keys, True)
    found, n = [], high - low
    ends = np.cumsum(n)
    at = 0
    while at < len(suffix):
        # Suffixes with about _PAIRS hits together, one suffix at least.
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
        found.append(_longest(flat, offsets, docs, held, places, suffix[at:to], low[at:to], n[at:to]))
        at = to
    return _best(np.concatenate(found))


def _longest(flat: np.ndarray, offsets: np.ndarray, docs: list, held: HeldOut, places: np.ndarray, suffix: np.ndarray, low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows of the longest matches of some held-out suffixes with the ranges of training suffixes that begin alike."""
    q = np.repeat(held.start[suffix], n)
    item = np.repeat(held.item[suffix], n)
    p = places[np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
    longest = flat[p - 1] != held.flat[q - 1]  # neither goes on to the left
    p, q, item = p[longest], q[longest], item[longest]
    size = np.full(len(p), held.least, np.int64)
    on = np.arange(len(p))
    while len(on):
        on = on[flat[p[on] + size[on]] == held.flat[q[on] + size[on]]]
        size[on] += 1
    doc = np.searchsorted(offsets, p, "right") - 1
    ids = np.fromiter((d for d, _ in docs), np.int64, len(docs))
    return _best(np.stack([ids[doc], item, size, p - offsets[doc], q - held.begin[np.searchsorted(held.begin, q, "right") - 1]], axis=1))


def _best(rows: np.ndarray) -> np.ndarray:
    """The longest row of each document and item, the first in the document and the item where several are."""
    if not len(rows):
        return _NO_HITS
    rows = rows[np.lexsort((rows[:, 4], rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[new]


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int32()), ("doc_word", pa.int32()), ("item_word", pa.int32())])
#: The block that a worker read last: (token, block) -> its words and suffixes.
_held: dict[tuple[str, int], HeldOut] = {}


def _block(token: str, number: int, sent: object, least: int) -> HeldOut:
    """A block of held-out texts, of which a worker keeps one."""
    if (token, number) not in _held:
        _held.clear()
        _held[token, number] = HeldOut(sent.value, least)
    return _held[token, number]


def _search(corpus: DataFrame, blocks: list[object], least: int) -> DataFrame:
    """(doc_id, item_id, n_words, doc_word, item_word) by shard and broadcast block, in one pass over the corpus."""
    token = uuid.uuid4().hex

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(docs: list[tuple[int, list[str]]]) -> Iterator[pa.RecordBatch]:
            for k, sent in enumerate(blocks):
                hits = search_shard(docs, _block(token, k, sent, least))
                yield pa.RecordBatch.from_arrays([pa.array(hits[:, c], f.type) for c, f in enumerate(_FOUND)], schema=_FOUND)

        shard: list[tuple[int, list[str]]] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words(text)
                if len(ws) < least:
                    continue
                if shard and size + len(ws) > SHARD_WORDS:
                    yield from found(shard)
                    shard, size = [], 0
                shard.append((doc, ws))
                size += len(ws)
        if shard:
            yield from found(shard)

    return corpus.mapInArrow(scan, "doc_id bigint, item_id bigint, n_words int, doc_word int, item_word int")


def leaks(corpus: DataFrame, held_out: DataFrame, least: int = LEAST_WORDS, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_words, doc_word, item_word) of every document and held-out item that have at least
    `least` consecutive words in common: their longest match and where it starts, counted in words from 0."""
    docs = corpus.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    texts = held_out.select(F.col(item).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id is not null and text is not null")
    size = texts.agg(F.sum(F.length("text")).alias("s")).first()["s"] or 0
    n = 1 + int(size) // BLOCK_CHARS
    sent = []
    for b in range(n):
        block = texts if n == 1 else texts.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b)
        sent.append(corpus.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in block.collect()]))
    found = _search(docs, sent, least)
    best = F.max(F.struct("n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.n_words"), (-F.col("b.d")).alias("doc_word"), (-F.col("b.i")).alias("item_word"))


def without_leaks(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """The corpus without the affected documents."""
    return corpus.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
