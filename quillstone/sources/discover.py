"""What is in semi-structured sources: key paths and coded values."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.structure import unwrap


def _walk(value: object, path: str) -> Iterator[tuple[str, object]]:
    """(path, value) of every key at any depth; elements of a list share the path with '[]', text that holds JSON is read through."""
    todo = [(path, value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, str) and v.lstrip()[:1] in ("{", "[", '"'):
            v = unwrap(v)
        if isinstance(v, dict):
            for k, x in v.items():
                p = f"{at}.{k}" if at else str(k)
                yield p, x
                todo.append((p, x))
        elif isinstance(v, list):
            todo += [(f"{at}[]", x) for x in v]


def key_paths(df: DataFrame, body: str) -> DataFrame:
    """(path, n) of all keys of JSON bodies; values are never kept. Counted inside each batch first."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter[str] = Counter()
            for text in b.column(0).to_pylist():
                try:
                    n.update(p for p, _ in _walk(json.loads(text), ""))
                except (TypeError, ValueError, RecursionError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["path", "n"])

    return df.select(F.col(body).cast("string")).mapInArrow(scan, "path string, n bigint").groupBy("path").agg(F.sum("n").alias("n"))


def coded_values(df: DataFrame, body: str, key: str = "kode", longest: int = 40) -> DataFrame:
    """(path, value, n) of short values under keys of one name."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter[tuple[str, str]] = Counter()
            for text in b.column(0).to_pylist():
                try:
                    for p, v in _walk(json.loads(text), ""):
                        if p.rpartition(".")[2] == key and isinstance(v, (str, int)) and len(str(v)) <= longest:
                            n[p, str(v)] += 1
                except (TypeError, ValueError, RecursionError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["path", "value", "n"])

    return df.select(F.col(body).cast("string")).mapInArrow(scan, "path string, value string, n bigint").groupBy("path", "value").agg(F.sum("n").alias("n"))
