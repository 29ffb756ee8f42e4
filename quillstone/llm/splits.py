"""Train, validation and test splits that keep related members together: component swap search.

Components of members tied by a register number, a cluster or a group of items are assigned as wholes.
Components with the same measures (size and labels) are interchangeable, so the search runs on kinds of
components with their numbers: it starts from the numbers that an assignment by hash gives, then chains of
simulated annealing move whole components of a kind from one split to another, or exchange some of one kind for some
of another, to bring the sizes of the splits and the counts of every label in them nearer to their shares; the
best of the chains is kept. Every step weighs PROPOSALS proposals at once, and there are as many steps a kind at
every size. Chains run in parallel, each over at most KINDS kinds (more are spread by hash over chunks, each
against its own shares). The components of a kind are then given out in the order of a hash, by ranks within
buckets, so that neither a kind nor a split is ever gathered in a task.

Null keys tie nothing; a member without any tie is a component of its own; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import register_number
from ..operators.components import roots
from ..operators.skew import lookup_join
from ..session import cut

SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
KINDS = 50_000
CHAINS = 3
SEED = 13
PROPOSALS = 64
#: Components of a kind in one bucket of the ranking, on average.
BUCKET = 4_096


def member_ties(members: DataFrame, items: DataFrame) -> DataFrame:
    """(member_id, key): every member under every key that ties it to others."""
    id_ = F.col("member_id").cast("bigint").alias("member_id")
    company = F.concat(F.lit("r|"), "jurisdiction", F.lit("|"), register_number(F.col("jurisdiction"), F.col("entity_id")))
    cluster = F.when(F.col("cluster") != "", F.concat(F.lit("c|"), "cluster"))
    own = members.select(id_, F.explode(F.array(company, cluster)).alias("key")).where("key is not null")
    groups = cut(items.select("rid", "grp").where("rid is not null and grp is not null").distinct())
    sizes = groups.groupBy("rid").agg(F.count("*").alias("n"))
    named = members.select(id_, "rid").where("rid is not null and member_id is not null").distinct()
    firsts = cut(named.groupBy("rid").agg(F.min("member_id").alias("first"), F.count("*").alias("k")).join(sizes, "rid"))
    by_item = lookup_join(groups, firsts, "rid", "n", "first").select(F.col("first").alias("member_id"), F.concat(F.lit("g|"), "grp").alias("key"))
    same = named.join(firsts.where("k > 1").select("rid"), "rid").select("member_id", F.concat(F.lit("i|"), "rid").alias("key"))
    return own.unionAll(by_item).unionAll(same)


def anneal(size: np.ndarray, counts: np.ndarray, target: np.ndarray, seed: int, steps: int) -> tuple[float, np.ndarray]:
    """Cost and counts after annealing. size: kind x measure (the first is the number of members); counts: kind x split,
    the numbers of components; target: split x measure. The cost is the squared relative deviation, summed over splits and
    measures. Each step draws PROPOSALS moves and exchanges of whole components and takes the best, or with some heat a worse one."""
    rng = np.random.default_rng(seed)
    n, splits = counts.shape
    weight = 1.0 / np.maximum(target.sum(axis=0), 1.0) ** 2
    now = counts.astype(np.int64).copy()
    over = now.T @ size - target
    cost = float((over**2 * weight).sum())
    best, kept = cost, now.copy()
    heat0 = max(cost, 1e-12) / 20
    own = (size**2 * weight).sum(axis=1)
    for k in range(steps):
        i, j = rng.integers(0, n, (2, PROPOSALS))
        a = rng.integers(0, splits, PROPOSALS)
        b = (a + rng.integers(1, splits, PROPOSALS)) % splits
        swap = rng.random(PROPOSALS) < 0.5
        # As many of a kind as would be best by themselves, or one; in exchange for one of the other kind.
        pull = ((over[a] - over[b]) * weight * size[i]).sum(axis=1) / np.maximum(2 * own[i], 1e-300)
        many = np.where(rng.random(PROPOSALS) < 0.7, np.maximum(np.floor(pull), 1), 1).astype(np.int64)
        many = np.minimum(many, now[i, a])
        one = (swap & (now[j, b] > 0) & (i != j)).astype(np.int64)
        gain = many[:, None] * size[i] - one[:, None] * size[j]
        change = (2 * weight * gain * (gain + over[b] - over[a])).sum(axis=1)
        change[many == 0] = np.inf
        heat = heat0 * (1 - k / steps) ** 3 + 1e-18
        with np.errstate(invalid="ignore"):
            at = int(np.argmin(change + heat * rng.gumbel(size=PROPOSALS)))
        if not np.isfinite(change[at]) or (change[at] > 0 and rng.random() >= np.exp(-change[at] / heat)):
            continue
        i, j, a, b = i[at], j[at], a[at], b[at]
        now[i, a] -= many[at]
        now[i, b] += many[at]
        now[j, b] -= one[at]
        now[j, a] += one[at]
        over[a] -= gain[at]
        over[b] += gain[at]
        cost += float(change[at])
        if cost < best - 1e-15:
            best, kept = cost, now.copy()
    return best, kept


def assign(components: DataFrame, measures: Sequence[str], shares: Sequence[tuple[str, float]] = SHARES, steps_per: int = 2) -> DataFrame:
    """(root_id, split) of every component of `components` (root_id and the measures, of which the first is its size)."""
    names, columns = [s for s, _ in shares], list(measures)
    part = np.array([p for _, p in shares], float) / sum(p for _, p in shares)
    edges = np.cumsum(part)
    order = F.xxhash64(F.col("root_id"), F.lit(SEED))
    luck = F.pmod(order, F.lit(1 << 30)) / F.lit(float(1 << 30))
    hashed = F.coalesce(*[F.when(luck < float(e), i) for i, e in enumerate(edges[:-1])], F.lit(len(names) - 1))
    rows = components.select("root_id", *columns, order.alias("order"), hashed.alias("start"), F.xxhash64(*columns).alias("_kind"))
    kinds = cut(rows.groupBy("_kind").agg(*[F.first(c).alias(c) for c in columns], F.count("*").alias("_n"), *[F.count_if(F.col("start") == i).alias(f"_s{i}") for i in range(len(names))]))
    chunks = 1 + (kinds.count() - 1) // KINDS
    ends = [f"_s{i}" for i in range(len(names))]

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_kind")
        size, counts = pdf[columns].to_numpy(float), pdf[ends].to_numpy(np.int64)
        target = part[:, None] * (counts.sum(axis=1) @ size)
        cost, now = anneal(size, counts, target, SEED + int(key[1]), 300 + steps_per * len(size))
        return pd.DataFrame({"_kind": pdf["_kind"], "_n": pdf["_n"], "cost": cost, "chain": key[1], "ends": list(np.cumsum(now, axis=1))})

    chains = kinds.withColumn("chunk", F.pmod("_kind", F.lit(max(chunks, 1))).cast("int")).withColumn("chain", F.explode(F.array(*[F.lit(c) for c in range(CHAINS)])))
    tried = chains.groupBy("chunk", "chain").applyInPandas(chain, "_kind bigint, _n bigint, cost double, chain int, ends array<bigint>")
    given = cut(tried.groupBy("_kind", "_n").agg(F.min_by("ends", F.struct("cost", "chain")).alias("ends")).select("_kind", "_n", F.struct(F.col("_n").alias("n"), "ends").alias("g")))

    # Ranks of the components of a kind: within buckets, which follow one another.
    sought = lookup_join(rows.select("root_id", "order", "_kind"), given, "_kind", "_n", "g").withColumn("bucket", F.pmod("order", 1 + (F.col("g.n") / BUCKET).cast("bigint")))
    sought = cut(sought)
    before = Window.partitionBy("_kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sought.groupBy("_kind", "bucket").agg(F.count("*").alias("k")).select("_kind", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    ranked = sought.join(first, ["_kind", "bucket"]).withColumn("rank", F.col("first") + F.row_number().over(Window.partitionBy("_kind", "bucket").orderBy("order", "root_id")) - 1)
    split = F.coalesce(*[F.when(F.col("rank") < F.get("g.ends", F.lit(i)), s) for i, s in enumerate(names[:-1])], F.lit(names[-1]))
    return ranked.select("root_id", split.alias("split"))


def split_members(members: DataFrame, items: DataFrame, shares: Sequence[tuple[str, float]] = SHARES, labels: dict[str, Column] | None = None) -> DataFrame:
    """(member_id, root_id, split) of every member; `labels` are 0/1 measures whose shares are kept besides the size."""
    if labels is None:
        labels = {f"n_{j.lower()}": (F.col("jurisdiction") == j) for j in ("NO", "AT", "DK")} | {"n_text": F.col("has_text")}
    found = roots(member_ties(members, items), members.select(F.col("member_id").cast("bigint").alias("member_id")))
    marks = members.dropDuplicates(["member_id"]).select(F.col("member_id").cast("bigint").alias("member_id"), *[F.coalesce(c.cast("int"), F.lit(0)).alias(n) for n, c in labels.items()])
    components = found.join(marks, "member_id").groupBy("root_id").agg(F.count("*").alias("n_members"), *[F.sum(n).alias(n) for n in labels])
    components = cut(components)
    given = assign(components, ["n_members", *labels])
    sized = given.join(components.select("root_id", "n_members"), "root_id")
    return lookup_join(found, sized, "root_id", "n_members", "split")
