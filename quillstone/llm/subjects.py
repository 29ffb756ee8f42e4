"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs.

A sentence is the average of the embeddings of its words and of their character n-grams, hashed to BUCKETS
rows; one logistic output a subject says whether the sentence deals with it. A document has the subjects that
at least `least` of its sentences deal with.

Training uses hand labels of documents, at most MOST_LABELLED of them (the first by a hash of the id), laid out
once in SHARDS partitions. Every step is synchronous: the weights are broadcast, each partition gives the
gradient of its part of the batch (half floats, touched buckets only), the gradients are summed and one step
is taken with the sum. Labels tell of documents, not of sentences: in the first rounds a sentence takes the
subjects of its document as targets; later a sentence keeps a subject of its document only if the model sees
it there, and one that the document isn't labelled with counts as dealt with in passing if the model is
sure and fewer than `least` sentences of the document deal with it. So a few wrong labels and passing
sentences do little harm.

Scoring reads every document once, whole, without a shuffle. What is broadcast and what a partition gives back
are at most BUCKETS x SIZE numbers, whatever the data.

Defined cases: null, empty and blank texts have no sentences and no subjects; labels of unknown subjects or
documents are left out; repeated labels count once; any number of subjects; without any label no document gets
a subject; rows repeated with one id give one row a subject; empty tables give empty ones; other columns
aren't read.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..session import cut

BUCKETS = 1 << 15
SIZE = 16
SHARDS = 4
#: Parts of the labelled documents that take turns; a step goes over one of them.
BATCHES = 4
MOST_LABELLED = 20_000
LEAST_SENTENCES = 3
ROUNDS = (4, 8)  # rounds on labels of documents, then on labels of sentences
RATE = 0.3
#: A sentence deals with a subject from this logit on: rare and misspelt words make weak outputs, and few others come near.
FROM_LOGIT = -1.5
_GRAMS = (3, 4, 5)
_MARKUP = re.compile(r"<[^<>]{1,200}>")
#: A word, or the end of a sentence.
_TOKENS = re.compile(r"[^\W_]+|(?<=[.!?…])[\"»”’)\]]*\s+|\n\s*\n")
_END, _NUMBER = 0, 1


def tokens(text: str | None) -> list[str]:
    """Words of the folded text and, between them, the ends of sentences; tags end a sentence."""
    if not text:
        return []
    return _TOKENS.findall(fold((_MARKUP.sub("\n\n", text) if "<" in text else text).replace("\r\n", "\n")))


def features(word: str) -> list[int]:
    """Buckets of a word and its n-grams."""
    w = f"<{word}>"
    grams = [w[i : i + n] for n in _GRAMS for i in range(len(w) - n + 1)] if len(w) > 4 else []
    return [zlib.crc32(g.encode()) % BUCKETS for g in [w, *grams]]


class Numbers(dict):
    """Numbers of tokens, given out as they are met; all ends of sentences are one, and so are all numbers."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[str] = ["", ""]

    def __missing__(self, token: str) -> int:
        if not token[0].isalnum():
            k = _END
        elif token.isdigit():
            k = _NUMBER
        else:
            k = len(self.words)
            self.words.append(token)
        self[token] = k
        return k


@dataclass
class Laid:
    """Sentences of some texts: their word numbers, one after another; first word and text of each sentence."""

    word: np.ndarray
    start: np.ndarray
    text: np.ndarray


def lay(texts: list[str | None], numbers: Numbers) -> Laid:
    """The sentences of texts, with words as numbers; numbers written in digits are left out."""
    flat: list[str] = []
    until = []
    for t in texts:
        flat += tokens(t)
        flat.append(" ")
        until.append(len(flat))
    n = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
    sentence = np.cumsum(n == _END)
    kept = np.flatnonzero(n > _NUMBER)
    start = np.flatnonzero(np.diff(sentence[kept], prepend=-1))
    return Laid(n[kept], start, np.searchsorted(until, kept[start], "right"))


def _table(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words one after another, the first of each word, and their number."""
    found = [features(w) for w in words]
    n = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((b for f in found for b in f), np.int64, int(n.sum()))
    return flat, np.cumsum(n) - n, n


class Chunk:
    """Labelled documents laid out for training; `pack` and `unpack` carry it in one binary value."""

    def __init__(self, word: np.ndarray, start: np.ndarray, doc: np.ndarray, labels: np.ndarray, buckets: np.ndarray, first: np.ndarray, n_features: np.ndarray) -> None:
        self.word, self.start, self.doc, self.labels = word, start, doc, labels
        self.buckets, self.first, self.n_features = buckets, first, n_features

    @classmethod
    def of(cls, texts: list[str], given: list[list[int]], subjects: int) -> Chunk:
        numbers = Numbers()
        laid = lay(texts, numbers)
        labels = np.zeros((len(texts), subjects), bool)
        for row, ks in enumerate(given):
            labels[row, ks] = True
        return cls(laid.word - 2, laid.start, laid.text, labels, *_table(numbers.words[2:]))

    def pack(self) -> bytes:
        out = io.BytesIO()
        small = lambda a: a.astype(np.int32)
        np.savez(out, word=small(self.word), start=small(self.start), doc=small(self.doc), labels=self.labels, buckets=small(self.buckets), first=small(self.first), n_features=small(self.n_features))
        return out.getvalue()

    @classmethod
    def unpack(cls, packed: bytes) -> Chunk:
        with np.load(io.BytesIO(packed)) as z:
            return cls(*(z[k] for k in ("word", "start", "doc", "labels", "buckets", "first", "n_features")))

    def gradient(self, emb: np.ndarray, out: np.ndarray, off: np.ndarray, by_sentence: bool, least: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sentences, buckets touched, and the summed gradients of their embeddings, of the output weights and of the offsets."""
        n = np.diff(self.start, append=len(self.word))
        of_word = np.add.reduceat(emb[self.buckets], self.first, axis=0)
        total = np.add.reduceat(self.n_features[self.word], self.start)
        h = np.add.reduceat(of_word[self.word], self.start, axis=0) / total[:, None]
        p = 1 / (1 + np.exp(-(h @ out + off)))
        given = self.labels[self.doc]
        d = (p - (targets(p, given, self.doc, least) if by_sentence else given)).astype(np.float32)
        back = ((d @ out.T) / total[:, None]).astype(np.float32)
        order = np.argsort(self.word, kind="stable")  # every word occurs, so that its sums stand in the order of words
        words = np.add.reduceat(back[np.repeat(np.arange(len(n)), n)[order]], np.searchsorted(self.word[order], np.arange(len(self.first))), axis=0)
        order = np.argsort(self.buckets, kind="stable")
        touched, at = np.unique(self.buckets[order], return_index=True)
        embs = np.add.reduceat(words[np.repeat(np.arange(len(self.first)), self.n_features)[order]], at, axis=0)
        return len(n), touched, embs, (h.T @ d).astype(np.float32), d.sum(axis=0)


def targets(p: np.ndarray, given: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Targets of sentences from what the model sees and what the documents are labelled with."""
    rank = np.empty(p.shape, np.int64)
    for k in range(p.shape[1]):
        order = np.argsort(doc * 2.0 - p[:, k], kind="stable")
        rank[order, k] = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
    seen = np.maximum(0.3, 1.5 * given.mean(axis=0))  # more than a sentence without any sign of the subject would have
    own = given & ((p > seen) | ((rank < least) & (p > 0.08)))
    sure = ~given & (p > 0.6)
    per_doc = np.zeros((doc.max() + 1, p.shape[1]), np.int64)
    np.add.at(per_doc, doc, sure)
    return (own | (sure & (per_doc[doc] < least))).astype(np.float32)


class Weights:
    """Embeddings, output weights and offsets, with the moments of their steps."""

    def __init__(self, subjects: int, steps: int, seed: int = 13) -> None:
        rng = np.random.default_rng(seed)
        emb = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
        self.values = [emb, rng.normal(0, 0.5, (SIZE, subjects)).astype(np.float32), np.full(subjects, -2.0, np.float32)]
        self.mean, self.square = [np.zeros_like(v) for v in self.values], [np.zeros_like(v) for v in self.values]
        self.step, self.steps = 0, steps

    def move(self, gradients: list[np.ndarray]) -> None:
        """One step along summed gradients, shorter towards the end, each weight scaled by its own past gradients."""
        self.step += 1
        rate = RATE * (1 - 0.9 * (self.step - 1) / self.steps)
        for value, g, mean, square, scale in zip(self.values, gradients, self.mean, self.square, (1.0, 1.0, 0.3)):
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            value -= rate * scale * (mean / (1 - 0.9**self.step)) / (np.sqrt(square / (1 - 0.99**self.step)) + 1e-8)


def _half(a: np.ndarray) -> tuple[float, bytes]:
    """An array as half floats and the scale that keeps them in range."""
    scale = float(np.abs(a).max(initial=0.0)) or 1.0
    return scale, (a / scale).astype(np.float16).tobytes()


def fit(documents: DataFrame, labels: DataFrame, subjects: list[str], least: int = LEAST_SENTENCES, rounds: tuple[int, int] = ROUNDS) -> list[np.ndarray] | None:
    """Embeddings, output weights and offsets from the labelled documents (documents: doc_id, text; labels: doc_id, subject), or None without any."""
    spark, k = documents.sparkSession, len(subjects)
    number = spark.createDataFrame(list(enumerate(subjects)), "number int, subject string")
    known = labels.join(F.broadcast(number), "subject").groupBy("doc_id").agg(F.sort_array(F.collect_set("number")).alias("given"))
    known = known.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(BATCHES)).cast("int"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, given, batch = (b.column(i).to_pylist() for i in range(3))
            for turn in range(BATCHES):
                at = [i for i, x in enumerate(batch) if x == turn]
                c = Chunk.of([texts[i] for i in at], [given[i] for i in at], k)
                if len(c.start):
                    yield pa.RecordBatch.from_arrays([pa.array([turn], pa.int32()), pa.array([c.pack()], pa.binary())], names=["batch", "chunk"])

    shards = rows.repartition(SHARDS, "doc_id").sortWithinPartitions("doc_id").select("text", "given", "batch")
    packed = cut(shards.mapInArrow(pack, "batch int, chunk binary"))
    turns = sorted(r["batch"] for r in packed.select("batch").distinct().collect())
    if not turns:
        return None
    weights = Weights(k, sum(rounds) * len(turns))
    for r in range(sum(rounds)):
        for turn in turns:
            sent = spark.sparkContext.broadcast(weights.values)
            got = packed.where(F.col("batch") == turn).mapInArrow(_gradients(sent, r >= rounds[0], least), _GRADIENT_SCHEMA).collect()
            weights.move(_summed(got, k))
            sent.destroy()
    return weights.values


_GRADIENT = pa.schema([("n", pa.int64()), ("buckets", pa.binary()), ("scale", pa.float64()), ("emb", pa.binary()), ("out", pa.binary()), ("off", pa.binary())])
_GRADIENT_SCHEMA = "n bigint, buckets binary, scale double, emb binary, out binary, off binary"


def _gradients(sent: object, by_sentence: bool, least: int) -> object:
    """The work of one partition in one step: its chunks in, one row with their summed gradients out."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for packed in b.column(1).to_pylist():
                n, touched, emb, out, off = Chunk.unpack(packed).gradient(*sent.value, by_sentence, least)
                if total is None:
                    total = [0, np.zeros((BUCKETS, SIZE), np.float32), np.zeros(BUCKETS, bool), np.zeros_like(out), np.zeros_like(off)]
                total[0] += n
                total[1][touched] += emb
                total[2][touched] = True
                total[3] += out
                total[4] += off
        if total is not None:
            touched = np.flatnonzero(total[2]).astype(np.int32)
            scale, emb = _half(total[1][touched])
            row = (total[0], touched.tobytes(), scale, emb, total[3].tobytes(), total[4].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _GRADIENT)], schema=_GRADIENT)

    return scan


def _summed(rows: list, subjects: int) -> list[np.ndarray]:
    """Average gradients over all partitions, summed in a fixed order."""
    emb, out, off = np.zeros((BUCKETS, SIZE), np.float32), np.zeros((SIZE, subjects), np.float32), np.zeros(subjects, np.float32)
    for r in sorted(rows, key=lambda r: (r["n"], bytes(r["off"]))):
        emb[np.frombuffer(r["buckets"], np.int32)] += np.frombuffer(r["emb"], np.float16).reshape(-1, SIZE).astype(np.float32) * r["scale"]
        out += np.frombuffer(r["out"], np.float32).reshape(SIZE, subjects)
        off += np.frombuffer(r["off"], np.float32)
    n = sum(r["n"] for r in rows)
    return [emb / n, out / n, off / n]


class Scorer:
    """Counts the sentences of texts that deal with each subject. What a word adds to the outputs is worked out once."""

    def __init__(self, emb: np.ndarray, out: np.ndarray, off: np.ndarray, most_words: int = 300_000) -> None:
        self.emb, self.out, self.off, self.most_words = emb, out, off, most_words
        self.numbers, self.added, self.n = Numbers(), np.zeros((2, len(off)), np.float32), np.ones(2, np.int64)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """text x subject."""
        if len(self.numbers.words) > self.most_words:
            self.numbers, self.added, self.n = Numbers(), self.added[:2], self.n[:2]
        laid = lay(texts, self.numbers)
        if len(new := self.numbers.words[len(self.n) :]):
            flat, first, n = _table(new)
            self.added = np.concatenate([self.added, np.add.reduceat(self.emb[flat], first, axis=0) @ self.out])
            self.n = np.concatenate([self.n, n])
        found = np.zeros((len(texts), len(self.off)), np.int64)
        if len(laid.start):
            logit = np.add.reduceat(self.added[laid.word], laid.start, axis=0) / np.add.reduceat(self.n[laid.word], laid.start)[:, None] + self.off
            np.add.at(found, laid.text, logit >= FROM_LOGIT)
        return found


def assign(documents: DataFrame, labels: DataFrame, areas: DataFrame, least: int = LEAST_SENTENCES) -> DataFrame:
    """(doc_id, subject, n_sentences) of every document and subject that at least `least` sentences deal with.

    `areas` (subject) is the fixed table of subjects, of any number."""
    subjects = sorted(r["subject"] for r in areas.select("subject").where("subject is not null").distinct().collect())
    weights = fit(documents, labels, subjects, least) if subjects else None
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    schema = "doc_id bigint, subject string, n_sentences int"
    if weights is None:
        return documents.sparkSession.createDataFrame([], schema)
    sent = documents.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        names = pa.array(subjects, pa.string())
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                n = scorer.count(part.column(1).to_pylist())
                text, subject = np.nonzero(n >= least)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), names.take(pa.array(subject)), pa.array(n[text, subject].astype(np.int32))], names=["doc_id", "subject", "n_sentences"])

    return rows.mapInArrow(score, schema)
