"""Encoding of a corpus with a byte-level BPE vocabulary: speculate and verify.

Speculate: each piece of text (by the pattern of the vocabulary) is cut greedily into its longest
tokens. Verify: a sequence of tokens is the BPE encoding of a piece exactly if every adjacent pair
is compatible, that is, if the two tokens' bytes together encode to just these two tokens; all pairs
of a batch are tested at once against the pairs known so far. Only pieces with an incompatible pair
are merged exactly, by rank, with a heap, so that a piece of n bytes takes n log n steps.

Distinct pieces are numbered in each Python worker, with their ids in one flat array, in a table of bounded
size, so that a piece is worked on once a worker as a rule; a text is then a row of numbers, and its ids are
gathered without a loop. The vocabulary is read on the driver and broadcast (its size is fixed, whatever the
corpus). No shuffle: the corpus is read once and rows stay where they are.

Defined cases: null and empty texts have an empty list; white space is text; lone surrogates can't
occur in Spark strings; any other text is encoded whole, however long; special tokens are ordinary
text; rows that occur twice are encoded twice; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pattern that cuts text into pieces before the merges (fixed value of the vocabulary).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for texts of characters for which letters are all word characters but digits and '_'.
_PLAIN_PIECES = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
#: Any other character: beyond Latin letters and general punctuation, or a number that is no digit, or a rare control character.
_NOT_PLAIN = re.compile("[^\t\n\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e]")
#: Folder of the public vocabulary files unless the caller names another.
TOKENIZERS = os.environ.get("QUILLSTONE_TOKENIZERS", "/opt/tokenizers")
_PAIR_BITS = 20


class Pieces(dict):
    """Numbers of pieces, given out as they are met."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = k = len(self)
        self.new.append(piece)
        return k


class Codec:
    """Encoder for one vocabulary of byte ranks."""

    def __init__(self, ranks: dict[bytes, int], most_pieces: int = 500_000) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest: dict[bytes, int] = {}  # longest token that begins with these one or two bytes
        for b in ranks:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 1), len(b))
        self.pieces = regex.compile(PIECES)
        self.most_pieces = most_pieces
        self.forget()
        self.pairs = np.empty(0, np.int64)
        self.fits = np.empty(0, bool)
        self.failed = self.tested = 0

    def forget(self) -> None:
        """Empties the table of pieces."""
        self.known = Pieces()
        self.flat, self.first, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    @classmethod
    def parse(cls, data: bytes) -> Codec:
        """From the content of a rank file: a base64 token and its rank a line."""
        return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())})

    @classmethod
    def load(cls, path: str) -> Codec:
        """From a rank file."""
        return cls.parse(Path(path).read_bytes())

    def greedy(self, word: bytes) -> list[int]:
        """Longest-match tokens from the left."""
        out, at, n, ranks, longest = [], 0, len(word), self.ranks, self.longest
        while at < n:
            end = min(n, at + longest.get(word[at : at + 2], 1))
            while end > at + 1 and word[at:end] not in ranks:
                end -= 1
            out.append(ranks[word[at:end]])
            at = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: merges the adjacent pair of lowest rank, leftmost first, until none is left.

        Parts are a linked list over their first bytes; the heap holds (rank, place, end) of pairs, and a pair is
        stale if its parts have changed since."""
        n, ranks = len(word), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, end = heappop(heap)
            if gone[i] or (j := after[i]) >= n or after[j] != end:
                continue
            gone[j] = 1
            after[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(word[i : after[end]])) is not None:
                    heappush(heap, (r, i, after[end]))
            if (b := before[i]) >= 0 and (r := ranks.get(word[b:end])) is not None:
                heappush(heap, (r, b, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : after[i]]])
            i = after[i]
        return out

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (left id << bits | right id) encodes to itself; asks exactly once for each pair."""
        new = np.unique(keys)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, new), len(self.pairs) - 1)
            new = new[self.pairs[at] != new]
        if len(new):
            mask = (1 << _PAIR_BITS) - 1
            fits = np.fromiter(
                (self.merge(self.bytes_of[k >> _PAIR_BITS] + self.bytes_of[k & mask]) == [k >> _PAIR_BITS, k & mask] for k in new.tolist()), bool, len(new)
            )
            both = np.concatenate([self.pairs, new])
            order = np.argsort(both, kind="stable")
            self.pairs, self.fits = both[order], np.concatenate([self.fits, fits])[order]
        return self.fits[np.searchsorted(self.pairs, keys)]

    def learn(self, words: list[str]) -> None:
        """Works out the ids of the pieces that were numbered last."""
        raw = [w.encode("utf-8", "replace") for w in words]
        tokens = [self.greedy(w) for w in raw]
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((t for ts in tokens for t in ts), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(tokens)), lengths)
        inner = owner[1:] == owner[:-1]
        keys = ((flat[:-1] << _PAIR_BITS) | flat[1:])[inner]
        bad = np.unique(owner[1:][inner][~self.compatible(keys)]) if len(keys) else ()
        if len(bad):
            for i in bad:
                tokens[i] = self.merge(raw[i])
            lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
            flat = np.fromiter((t for ts in tokens for t in ts), np.int64, int(lengths.sum()))
        self.tested += len(words)
        self.failed += len(bad)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(lengths) - lengths])
        self.size = np.concatenate([self.size, lengths])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of each."""
        if len(self.known) > self.most_pieces:
            self.forget()
        cut: list[str] = []
        until = []
        for t in texts:
            if t:
                cut += self.pieces.findall(t) if _NOT_PLAIN.search(t) else _PLAIN_PIECES.findall(t)
            until.append(len(cut))
        number = np.fromiter(map(self.known.__getitem__, cut), np.int64, len(cut))
        if self.known.new:
            new, self.known.new = self.known.new, []
            self.learn(new)
        size = self.size[number]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.first[number] - ends[:-1], size) + np.arange(ends[-1])
        return self.flat[at], ends[np.concatenate([[0], until]).astype(np.int64)]


_codecs: dict[str, Codec] = {}


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of each row of `df`, without special tokens. The file `vocabulary` in `folder` is read on the driver."""
    path = Path(folder) / vocabulary
    sent, name = df.sparkSession.sparkContext.broadcast(path.read_bytes()), str(path)
    kind = df.schema[key].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _codecs[name] if name in _codecs else _codecs.setdefault(name, Codec.parse(sent.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                flat, offsets = c.encode_batch(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(scan, f"`{key}` {kind}, ids array<int>")
