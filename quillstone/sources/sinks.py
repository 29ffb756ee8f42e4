"""Writers: routed and split outputs, hashes of files, logs, tables for reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


def routed(df: DataFrame, route: Column, path: str) -> DataFrame:
    """Writes rows to a folder a route, and gives the number of rows of each; `df` is worked out once."""
    rows = cut(df.withColumn("route", route))
    rows.write.mode("overwrite").partitionBy("route").json(path)
    return rows.groupBy("route").agg(F.count("*").alias("n"))


def parts(df: DataFrame, split: str, part: str, path: str) -> None:
    """JSON lines by split and part, gzipped."""
    df.write.mode("overwrite").partitionBy(split, part).option("compression", "gzip").json(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_replace("path", "^.*/(?=[^/]+$)", "").alias("path"), F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): files added, removed or changed since the stamp."""
    j = before.select("path", F.col("sha256").alias("a")).join(now.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return j.select("path", change.alias("change")).where("change is not null")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def rewrite(df: DataFrame, column: str, new: Column, keys: list[str]) -> DataFrame:
    """Rows whose value a transformation changes, with the new value."""
    return df.withColumn("_new", new).where(~F.col(column).eqNullSafe(F.col("_new"))).select(*keys, F.col("_new").alias(column))


def markdown(df: DataFrame, most: int = 1_000) -> str:
    """A small result as a table for reading; it refuses results of more rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = [df.columns, ["-"] * len(df.columns), *[["–" if v is None else str(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
