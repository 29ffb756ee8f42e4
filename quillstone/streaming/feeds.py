"""Streams: change feeds, logs of annotations, requests to decide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.calibrate import apply_policy
from ..operators.current import latest


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events and approximate distinct ids by window and key; rows later than the watermark are dropped."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, window), key)
    return w.agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("n_users")).select(F.col("window.start").alias("start"), key, "n", "n_users")


def new_ids(events: DataFrame, id: str, ts: str, late: str = "2 hours") -> DataFrame:
    """Each id once, as far back as the watermark reaches."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([id])


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each key, given out once they can't grow any more."""
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def upsert(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps the latest row of each key in one of two folders in turn, so that a failed batch can be repeated."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.schema(batch.schema).parquet(f"{path}/{(epoch + 1) % 2}")
            rows = known.unionByName(batch)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = batch
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{path}/{epoch % 2}")

    return write


def decide(requests: DataFrame, policy: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with a decision under a policy of thresholds; the policy is a small static table, joined to the stream."""
    return apply_policy(requests, policy, keys)
