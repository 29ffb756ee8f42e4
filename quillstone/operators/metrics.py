"""Quality of predictions: aggregates and curves over scored items.

Scored items have (rid, grp, qid, qtype, y, pred, conf, p_gold, has_text). Absent answers are rows that
aren't there or have a null y; they count nowhere. Curves need a total order: `prefix_sums` ranges rows over partitions, so that no task sorts everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, width


def scored(items: DataFrame) -> DataFrame:
    """Distinct items with a known answer and a prediction, with `ok` and `err`."""
    known = items.where("y is not null and pred is not null and conf is not null").distinct()
    return known.withColumn("ok", (F.col("y") == F.col("pred")).cast("int")).withColumn("err", 1 - F.col("ok"))


def accuracy_sets(items: DataFrame, sets: list[list[str]]) -> DataFrame:
    """n and accuracy of each grouping set in one pass; columns outside a set are null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    out = items.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    return out.agg(F.count("*").alias("n"), F.avg("ok").alias("accuracy"))


def confusion(items: DataFrame, by: list[str]) -> DataFrame:
    return items.groupBy(*by, "y", "pred").agg(F.count("*").alias("n"))


def macro_f1(items: DataFrame, by: list[str]) -> DataFrame:
    """Mean over the classes in answers or predictions of 2 hits / (answers + predictions)."""
    cells = confusion(items, by)
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(1).alias("s")), F.struct(F.col("pred").alias("c"), F.lit(1).alias("s")))).alias("x"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"), "n")
    per = sides.groupBy(*by, F.col("x.c").alias("c")).agg(F.sum("hit").alias("hits2"), F.sum("n").alias("total"))
    return per.groupBy(*by).agg(F.avg(F.col("hits2") / F.col("total")).alias("macro_f1"), F.count("*").alias("n_classes"))


def ece_width(items: DataFrame, by: list[str], bins: int = 15) -> DataFrame:
    """Expected calibration error over bins of equal width, closed on the right."""
    b = F.least(F.greatest(F.ceil(F.col("conf") * bins) - 1, F.lit(0)), F.lit(bins - 1))
    return _ece(items.withColumn("bin", b), by)


def _ece(binned: DataFrame, by: list[str]) -> DataFrame:
    per = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("ok").alias("a"), F.avg("conf").alias("c"))
    return per.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def prefix_sums(rows: DataFrame, by: list[str], order: list[Column], sums: list[str]) -> DataFrame:
    """Adds `k`, the place of each row in its group by `order` (from 1), and for each of `sums` the sum up to it.

    Rows are ranged over partitions by group and order; each partition is summed on its own, and what lies before it
    comes from one row a partition and group. Columns of these names that rows have already are replaced."""
    rows = rows.drop("k", "n_all", "_p", "_k", *[f"cum_{s}" for s in sums])
    parts = width(rows.sparkSession)
    laid = cut(rows.repartitionByRange(parts, *by, *order).withColumn("_p", F.spark_partition_id()))
    totals = laid.groupBy(*by, "_p").agg(F.count("*").alias("_k"), *[F.sum(s).alias(f"_s_{s}") for s in sums])
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    names = ["_k", *[f"_s_{s}" for s in sums]]
    offsets = totals.select(*by, "_p", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in names])
    inside = Window.partitionBy(*by, "_p").orderBy(*order)
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    here = laid.select("*", F.row_number().over(inside).alias("k"), *[F.sum(s).over(run).alias(f"cum_{s}") for s in sums])
    same = [here[c].eqNullSafe(offsets[c]) for c in [*by, "_p"]]
    cond = same[0]
    for x in same[1:]:
        cond = cond & x
    both = here.join(offsets, cond)
    return both.select(*[here[c] for c in rows.columns], (F.col("k") + F.col("_k")).alias("k"), *[(F.col(f"cum_{s}") + F.col(f"_s_{s}")).alias(f"cum_{s}") for s in sums])


def risk_coverage(items: DataFrame, by: list[str]) -> DataFrame:
    """Items by falling confidence with k, coverage and risk (share of errors among the first k)."""
    curve = prefix_sums(items, by, [F.desc("conf"), F.col("rid"), F.col("qid"), F.col("pred"), F.col("p_gold"), F.col("grp")], ["err"])
    n = items.groupBy(*by).agg(F.count("*").alias("n_all"))
    joined = curve.join(n, by) if by else curve.crossJoin(n)
    return joined.withColumn("coverage", F.col("k") / F.col("n_all")).withColumn("risk", F.col("cum_err") / F.col("k"))


def curve_summary(curve: DataFrame, by: list[str], alphas: list[float]) -> DataFrame:
    """Area under the risk-coverage curve and the largest coverage at each risk (0 if none)."""
    cover = [F.coalesce(F.max(F.when(F.col("risk") <= a + 1e-12, F.col("coverage"))), F.lit(0.0)).alias(f"coverage_at_{round(a * 100)}") for a in alphas]
    return curve.groupBy(*by).agg(F.avg("risk").alias("aurc"), *cover, F.count("*").alias("n"))


def risk_at_levels(curve: DataFrame, by: list[str], levels: list[float]) -> DataFrame:
    """Risk of the most confident share of items; their number is rounded half to even, at least 1."""
    at = F.explode(F.array(*[F.lit(x) for x in levels])).alias("level")
    wanted = curve.select(*by, "n_all").distinct().select(*by, "n_all", at)
    wanted = wanted.withColumn("k", F.greatest(F.lit(1), F.bround(F.col("level") * F.col("n_all")).cast("int")))
    return curve.select(*by, "k", "risk").join(wanted.select(*by, "k", "level"), [*by, "k"]).select(*by, "level", "risk")


def ece_mass(items: DataFrame, by: list[str], bins: int = 15) -> DataFrame:
    """Expected calibration error over bins of equal numbers of items, in order of confidence: the first n mod bins bins have one more."""
    order = [F.col("conf"), F.col("rid"), F.col("qid"), F.col("pred"), F.col("p_gold"), F.col("grp")]
    placed = prefix_sums(items, by, order, [])
    n = items.groupBy(*by).agg(F.count("*").alias("n_all"))
    t = (placed.join(n, by) if by else placed.crossJoin(n)).withColumn("b", F.least(F.lit(bins), F.col("n_all")))
    small = F.floor(F.col("n_all") / F.col("b"))
    extra = F.col("n_all") % F.col("b")
    k = F.col("k") - 1
    bin_ = F.when(k < extra * (small + 1), F.floor(k / (small + 1))).otherwise(extra + F.floor((k - extra * (small + 1)) / small))
    return _ece(t.withColumn("bin", bin_), by)


def kappa(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", quadratic: bool = False) -> DataFrame:
    """Agreement of two raters beyond chance; with one label and full agreement 1, else 0 where it isn't defined."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("n"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(*by, F.col(a).alias("_x")).agg(F.sum("n").alias("nx"))
    right = cells.groupBy(*by, F.col(b).alias("_y")).agg(F.sum("n").alias("ny"))
    weight = F.pow((F.col("_x") - F.col("_y")).cast("double"), F.lit(2.0)) if quadratic else (F.col("_x") != F.col("_y")).cast("double")
    grid = left.join(right, by) if by else left.crossJoin(right)
    chance = grid.groupBy(*by).agg(F.sum(weight * F.col("nx") * F.col("ny")).alias("expected"))
    seen = F.pow((F.col(a) - F.col(b)).cast("double"), F.lit(2.0)) if quadratic else (F.col(a) != F.col(b)).cast("double")
    actual = cells.groupBy(*by).agg(F.sum(seen * F.col("n")).alias("actual"))
    j = total.join(actual, by).join(chance, by) if by else total.crossJoin(actual).crossJoin(chance)
    k = F.when(F.col("expected") > 0, 1 - F.col("actual") * F.col("t") / F.col("expected")).otherwise(F.when(F.col("same") == F.col("t"), 1.0).otherwise(0.0))
    return j.select(*by, F.col("t").alias("n"), (F.col("same") / F.col("t")).alias("agreement"), k.alias("kappa"))


def nearest_rank(values: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    """Percentiles by nearest rank: the value at place round(p / 100 (n - 1)), half to even."""
    placed = prefix_sums(values.select(*by, value), by, [F.col(value)], [])
    n = values.groupBy(*by).agg(F.count("*").alias("n_all"))
    want = n.select(*by, "n_all", F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent"))
    want = want.withColumn("k", F.bround(F.col("percent") / 100 * (F.col("n_all") - 1)).cast("int") + 1)
    return placed.join(want, [*by, "k"]).select(*by, "percent", value)


def bootstrap(items: DataFrame, by: list[str], group: str = "grp", times: int = 500, seed: int = 13) -> DataFrame:
    """Interval of the accuracy from resampling groups: each group counts in each resample as often as a
    Poisson(1) draw taken from a hash of seed, resample and group. Groups are summed first; what is resampled is one row a group."""
    from ..functions.keys import unit_hash

    per = items.withColumn("_g", F.coalesce(F.col(group), F.concat(F.lit("\x01"), "rid"))).groupBy(*by, "_g").agg(F.sum("ok").alias("ok"), F.count("*").alias("n"))
    tried = per.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(times))))
    u = unit_hash(F.lit(seed), F.col("rep"), F.col("_g"))
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    draws = sum((F.when(u > s, 1).otherwise(0) for s in steps[1:]), F.when(u > steps[0], 1).otherwise(0))
    means = tried.withColumn("w", draws).groupBy(*by, "rep").agg((F.sum(F.col("w") * F.col("ok")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    return means.groupBy(*by).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.count("m").alias("n_resamples"))
