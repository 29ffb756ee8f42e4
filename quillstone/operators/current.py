"""Selection of the row, entry or text in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str], keep: str | None = None) -> DataFrame:
    """The last row of each key by `order`, with partial aggregation and without a sort; then only those
    for which `keep` holds. Rows that tie in `order` are told apart by all their columns."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order, F.to_json(F.struct(*rest)))
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")
    return out.where(keep) if keep else out


def in_force(entries: Column, today: Column, end: str = "to", valid: str | None = None) -> Column:
    """Entries of an array that hold on a day: not marked invalid, and without an end up to that day."""

    def holds(e: Column) -> Column:
        ok = e.getField(end).isNull() | (e.getField(end) > today)
        return ok & (F.coalesce(e.getField(valid), F.lit(True)) if valid else F.lit(True))

    return F.filter(entries, holds)


def current_text(entries: Column, text: str = "text", start: str = "from", end: str = "to") -> Column:
    """Text of the open entry with the latest start; a null start is the earliest, and of equal starts the first entry counts."""
    opened = F.filter(entries, lambda e: e.getField(end).isNull())
    placed = F.transform(opened, lambda e, i: F.struct(F.coalesce(e.getField(start), F.lit("")).alias("s"), (-i).alias("i"), e.getField(text).alias("t")))
    return F.array_max(placed).getField("t")


def current_or_last(entries: Column, end: str = "to") -> Column:
    """The first open entry, else the last one."""
    return F.coalesce(F.get(F.filter(entries, lambda e: e.getField(end).isNull()), F.lit(0)), F.try_element_at(entries, F.lit(-1)))


def periods(df: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Adds the end of each state: the start of the next row of its key; null while open."""
    from pyspark.sql import Window

    others = [c for c in df.columns if c not in (*keys, start)]
    return df.withColumn("until", F.lead(start).over(Window.partitionBy(*keys).orderBy(start, *others)))


def drop_reason(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that holds; null if the row stays."""
    out = F.lit(None).cast("string")
    for name, cond in reversed(rules):
        out = F.when(cond, name).otherwise(out)
    return out
