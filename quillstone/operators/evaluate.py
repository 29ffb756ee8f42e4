"""Blocks of metrics over scored items, and policies with a fallback.

Everything is a sum by group; a long table has one row a group, version and metric. Null probabilities count in no
mean; empty tables give empty ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics

#: Least probability that a logarithm is taken of.
FLOOR = 1e-12


def tempered(p: Column, temperature: float) -> Column:
    """A probability against its complement at a temperature."""
    a, b = F.pow(p, 1 / temperature), F.pow(1 - p, 1 / temperature)
    return F.when(p.isNotNull(), F.try_divide(a, a + b))


def versions(items: DataFrame, temperatures: dict[str, float]) -> DataFrame:
    """Each item once a version, with its confidences at the version's temperature (1: as it is)."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(t).alias("t")) for v, t in temperatures.items()]))
    rows = items.select("*", each.alias("v")).select(*items.columns, "v.version", "v.t")
    cases = lambda c: F.coalesce(*[F.when(F.col("version") == v, F.col(c) if t == 1 else tempered(F.col(c), t)) for v, t in temperatures.items()])
    return rows.withColumns({"conf": cases("conf"), "p_gold": cases("p_gold")}).drop("t")


def evaluate(items: DataFrame, by: list[str], temperatures: dict[str, float], bins: int = 15) -> DataFrame:
    """(by, version, n, accuracy, nll, brier, ece, macro_f1) of every group and version in one block."""
    keys = [*by, "version"]
    rows = versions(items, temperatures)
    p = F.col("p_gold")
    means = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ok").alias("accuracy"), F.avg(-F.log(F.greatest(p, F.lit(FLOOR)))).alias("nll"), F.avg((1 - p) * (1 - p)).alias("brier"))
    parts = [means, metrics.ece_width(rows, keys, bins).select(*keys, "ece"), metrics.macro_f1(rows, keys).select(*keys, "macro_f1")]
    return reduce(lambda a, b: a.join(b, keys), parts)


def with_fallback(wanted: DataFrame, policy: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, threshold, fallback) for every row of `wanted` (group, key): the group's own threshold of `policy` (group, key,
    threshold), or the strictest of all groups, flagged, where it has none. A null threshold abstains and is the strictest."""
    strict = policy.groupBy(key).agg(F.when(F.count("*") == F.count("threshold"), F.max("threshold")).alias("_strict"))
    own = policy.select(group, key, F.struct("threshold").alias("_own"))
    j = wanted.select(group, key).distinct().join(own, [group, key], "left").join(strict, key, "left")
    return j.select(group, key, F.when(F.col("_own").isNotNull(), F.col("_own.threshold")).otherwise(F.col("_strict")).alias("threshold"), F.col("_own").isNull().alias("fallback"))


def merged(asked: DataFrame, given: DataFrame, number: str, id: str, answer: str) -> DataFrame:
    """(number, id, answer, status) of `asked` (number, id) with the answers of `given` (number, id, answer): merged where
    number and id agree, else 'id differs', or 'missing' where the number was not answered; only merged rows have an answer."""
    g = given.select(number, F.col(id).alias("_id"), F.col(answer).alias("_answer"), F.lit(True).alias("_there"))
    j = asked.select(number, id).join(g, number, "left")
    status = F.when(F.col("_there").isNull(), "missing").when(F.col("_id").eqNullSafe(F.col(id)), "merged").otherwise("id differs")
    return j.select(number, id, F.when(status == "merged", F.col("_answer")).alias(answer), status.alias("status"))


def adjudicated(votes: DataFrame, adjudicator: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, source) of `votes` (keys, annotator, label): the label of all annotators of a key where two or more agree, else that of
    the annotator whom `adjudicator` (keys[0], annotator) names; keys without either have no row."""
    same = votes.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("label").alias("_a"), F.max("label").alias("_b"))
    named = votes.join(adjudicator, [keys[0], "annotator"]).groupBy(*keys).agg(F.min("label").alias("_named"))
    j = same.join(named, keys, "left").withColumn("_agree", (F.col("_n") >= 2) & (F.col("_a") == F.col("_b")))
    out = j.select(*keys, F.when(F.col("_agree"), F.col("_a")).otherwise(F.col("_named")).alias("label"), F.when(F.col("_agree"), "agreed").otherwise("adjudicated").alias("source"))
    return out.where("label is not null")


def coded_rules(functions: DataFrame) -> DataFrame:
    """(extract_id, offices, person_specific) of function entries by their codes alone: an office counts if all of its entries that may
    sign have the code E; any other one makes the rule person-specific; entries with the code X don't count."""
    f = functions.where("vart is null or vart <> 'X'").groupBy("extract_id", "fken").agg(F.min(F.coalesce(F.col("vart") == "E", F.lit(False))).alias("alone"))
    return f.groupBy("extract_id").agg(F.sort_array(F.collect_set(F.when(F.col("alone"), F.col("fken")))).alias("offices"), F.max(~F.col("alone")).alias("person_specific"))
