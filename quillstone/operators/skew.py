"""Joins that hold up when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose values travel by broadcast; each other key holds at most 1/HOT_KEYS of the rows.
HOT_KEYS = 2_000
#: Groups over which rows with a broadcast value are spread in the shuffle.
SALTS = 4_096


def lookup_join(left: DataFrame, keyed: DataFrame, key: str, count: str, value: str, how: str = "inner") -> DataFrame:
    """`left` with the column `value` of `keyed`, joined on `key`; how: inner or left.

    `keyed` has one row a key, a value that is never null, and under `count` the key's number of rows in
    `left`. The HOT_KEYS most frequent keys are broadcast (a table of that many rows, whatever the data).
    Their rows then cross the shuffle evenly, as they join on a salt taken from the row itself, which no key
    of the other side has; so no task gets more than about 1/HOT_KEYS of the rows for any one key. `left` is
    read once; `keyed` is read twice (for its most frequent keys and for the join), so a dear one should be cut
    first. Keys are broadcast as they are: join on hashes, not on texts."""
    slim = keyed.select(F.col(key), F.col(count).alias("_count"), F.col(value).alias("_value"))
    hot = slim.orderBy(F.desc("_count"), F.col(key)).limit(HOT_KEYS).select(key, F.col("_value").alias("_hot"))
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).cast("int")
    seen = left.join(F.broadcast(hot), key, "left").withColumn("_salt", salt)
    cold = slim.select(key, F.col("_value").alias("_cold"), F.lit(0).alias("_salt"))
    both = seen.join(cold, [key, "_salt"], "left")
    out = both.select(*left.columns, F.coalesce("_hot", "_cold").alias(value))
    return out if how == "left" else out.where(F.col(value).isNotNull())
