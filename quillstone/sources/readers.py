"""Readers of the file layouts that register data come in."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, also gzipped; blank and broken lines are left out. A gzipped file is one task, so that many files, or a repartition, should follow."""
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where(F.col("_broken").isNull()).drop("_broken")


def envelopes(spark: SparkSession, path: str, body: str) -> DataFrame:
    """Cached responses, one a file, that succeeded and have a body: (path, fetched_at, body)."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    e = rows.select("path", F.from_json("value", f"status_code int, fetched_at timestamp, body {body}").alias("e"))
    return e.where("e.status_code = 200 and e.body is not null").select("path", "e.fetched_at", "e.body")


def snapshot(spark: SparkSession, folder: str, prefix: str) -> str:
    """The latest of the files `prefix_<date>…` of a folder, by name; a listing, no read."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(str(s.getPath().getName()) for s in path.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(path))
    names = [n for n in names if n.startswith(f"{prefix}_")]
    if not names:
        raise FileNotFoundError(f"{folder}/{prefix}_*")
    return f"{folder}/{names[-1]}"


def xml_documents(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    """Elements `row` of XML files, prefixes of names ignored; broken ones are left out."""
    rows = spark.read.format("xml").options(rowTag=row, ignoreNamespace="true", attributePrefix="_", columnNameOfCorruptRecord="_broken").schema(f"{schema}, _broken string").load(path)
    return rows.where(F.col("_broken").isNull()).drop("_broken")


def zipped_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ";") -> DataFrame:
    """Rows of the single CSV member of each archive, with a heading and an optional byte order mark; read in blocks of lines."""
    names = pa.schema([(c, pa.string()) for c in columns])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv

        for b in batches:
            for content in b.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as f:
                    reader = csv.DictReader(io.TextIOWrapper(f, "utf-8-sig"), delimiter=sep)
                    block: list[dict] = []
                    for row in reader:
                        block.append({c: row.get(c) for c in columns})
                        if len(block) == 10_000:
                            yield pa.RecordBatch.from_pylist(block, schema=names)
                            block = []
                    if block:
                        yield pa.RecordBatch.from_pylist(block, schema=names)

    ddl = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(scan, ddl)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(rid, qid, values): logits by option, or the logarithms of probabilities, held above 1e-12."""
    rows = jsonl(spark, path, "rid string, qid string, logits map<string,double>, probabilities map<string,double>")
    logs = F.transform_values("probabilities", lambda k, p: F.log(F.greatest(p, F.lit(1e-12))))
    return rows.select("rid", "qid", F.coalesce("logits", logs).alias("values"))


def schema_types(text: Column) -> Column:
    """(type, fields) of the type blocks of a schema in the GraphQL definition language."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)type\s+\w+[^{]*\{[^}]*\}"), F.lit(0))
    fields = lambda b: F.regexp_extract_all(F.regexp_extract(b, r"(?s)\{(.*)\}", 1), F.lit(r"(?m)^\s*(\w+)\s*[(:]"), F.lit(1))
    return F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"type\s+(\w+)", 1).alias("type"), fields(b).alias("fields")))


def scrape(lines: Column, pattern: str, *names: str) -> Column:
    """Groups of a pattern in a log line; null where it doesn't match."""
    found = F.struct(*[F.regexp_extract(lines, pattern, i + 1).alias(n) for i, n in enumerate(names)])
    return F.when(lines.rlike(pattern), found)


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row a day, for requests by day."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))).alias("day"))


def not_fetched(ids: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Ids that have no cached response yet."""
    return ids.join(cache.select(*keys).distinct(), keys, "left_anti")
