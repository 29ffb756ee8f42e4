"""Temperatures, certified thresholds and abstention."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prob
from ..session import cut

#: Thresholds that are tried (fixed values).
LAMBDAS = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.92, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99, 0.995, 0.999]
ALPHAS = [0.01, 0.02, 0.05]
DELTA = 0.1
#: Range of temperatures (fixed values).
T_RANGE = (0.05, 20.0)


@F.pandas_udf(T.DoubleType())
def binomial_cdf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Probability of at most k errors among n at rate p, summed in logarithms; for the few rows of a grid."""

    def one(k: int, n: int, p: float) -> float:
        if k >= n:
            return 1.0
        terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(int(k) + 1)]
        top = max(terms)
        return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))

    return pd.Series([one(a, b, c) for a, b, c in zip(k, n, p)])


def threshold_table(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, threshold, n, err): answers and errors at or above each threshold, from one pass with one sum a threshold."""
    counts = []
    for i, lam in enumerate(LAMBDAS):
        above = F.col("conf") >= lam
        counts += [F.count_if(above).alias(f"n{i}"), F.count_if(above & (F.col("err") == 1)).alias(f"e{i}")]
    wide = items.groupBy(*by).agg(*counts)
    cells = F.explode(F.array(*[F.struct(F.lit(lam).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"e{i}").alias("err")) for i, lam in enumerate(LAMBDAS)]))
    return wide.select(*by, cells.alias("c")).select(*by, "c.*")


def certify(items: DataFrame, by: list[str], alphas: list[float] = ALPHAS, delta: float = DELTA) -> DataFrame:
    """(by, alpha, threshold): the lowest threshold whose risk is certified below alpha with confidence 1 - delta
    over the whole grid; null if none is. Thresholds that nothing reaches are skipped."""
    grid = threshold_table(items, by).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    tested = grid.withColumn("p", binomial_cdf("err", "n", "alpha"))
    ok = (F.col("n") > 0) & (F.col("p") <= delta / len(LAMBDAS))
    return tested.groupBy(*by, "alpha").agg(F.min(F.when(ok, F.col("threshold"))).alias("threshold"))


def strictest(policy: DataFrame, keys: list[str]) -> DataFrame:
    """One policy from several: the highest threshold of each key; a null, which always abstains, prevails."""
    return policy.groupBy(*keys).agg(F.when(F.count("*") == F.count("threshold"), F.max("threshold")).alias("threshold"))


def apply_policy(items: DataFrame, policy: DataFrame, keys: list[str]) -> DataFrame:
    """Items of every alpha with `answered`: false without a threshold or below it."""
    joined = items.join(policy, keys)
    return joined.withColumn("answered", F.coalesce(F.col("conf") >= F.col("threshold"), F.lit(False)))


def selective(answered: DataFrame, by: list[str]) -> DataFrame:
    """Coverage and risk of what is answered; the risk of nothing is null."""
    return answered.groupBy(*by).agg(F.avg(F.col("answered").cast("int")).alias("coverage"), (F.sum(F.when(F.col("answered"), F.col("err"))) / F.count_if("answered")).alias("risk"))


def fit_temperature(items: DataFrame, by: list[str], logits: str, y: str, steps: int = 25, passes: int = 3) -> DataFrame:
    """(by, t): the temperature of least mean negative log likelihood, by grids in log t, each finer around the last best.

    The loss is convex in 1/t, so the best of a grid brackets the best of all. A pass is one aggregation with
    one sum a grid point; between passes only one row a group is kept."""
    low, high = math.log(T_RANGE[0]), math.log(T_RANGE[1])
    state = items.select(*by).distinct().withColumn("lo", F.lit(low)).withColumn("hi", F.lit(high))
    for _ in range(passes):
        joined = items.join(state, by) if by else items.crossJoin(F.broadcast(state))
        at = [F.col("lo") + (F.col("hi") - F.col("lo")) * (i / (steps - 1)) for i in range(steps)]
        losses = [F.avg(prob.nll(prob.softmax(F.col(logits), F.exp(a)), F.col(y))).alias(f"l{i}") for i, a in enumerate(at)]
        best = joined.groupBy(*by, "lo", "hi").agg(*losses)
        place = F.array_position(F.array(*[F.col(f"l{i}") for i in range(steps)]), F.least(*[F.col(f"l{i}") for i in range(steps)])) - 1
        step = (F.col("hi") - F.col("lo")) / (steps - 1)
        mid = F.col("lo") + step * place
        state = best.select(*by, F.greatest(mid - step, F.lit(low)).alias("lo"), F.least(mid + step, F.lit(high)).alias("hi"))
        state = cut(state)
    return state.select(*by, F.exp((F.col("lo") + F.col("hi")) / 2).alias("t"))
