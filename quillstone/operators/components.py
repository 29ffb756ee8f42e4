"""Connected components of members that share keys, by rounds of contraction.

Each key ties its members to the smallest of them, one edge a member. A round points every node to the
smallest of its neighbours and itself, doubles the pointers until all lead to a local minimum, rewrites the
edges to these minima and drops those that became loops or repeats. Minima are no neighbours, so each round
at least halves the nodes, and doubling takes as many steps as the logarithm of the longest way; the rounds
end when no edge is left. All
steps are sums with partial aggregation and joins that split hot keys, so that a key with a third of all
members or a long chain of members does no harm. Every round is cut by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .skew import lookup_join


def _follow(rows: DataFrame, column: str, pointers: DataFrame) -> DataFrame:
    """`rows` with `column` replaced by what it points to; nodes without a pointer stay."""
    counts = rows.groupBy(column).agg(F.count("*").alias("_n"))
    keyed = pointers.select(F.col("node").alias(column), F.col("to").alias("_to")).join(counts, column)
    others = [c for c in rows.columns if c != column]
    return lookup_join(rows, keyed, column, "_n", "_to", how="left").select(*others, F.coalesce("_to", column).alias(column))


def roots(ties: DataFrame, members: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(member_id, root_id) of every row of `members` (member_id bigint): the smallest member of its component
    by `ties` (member_id bigint, key string). Members of ties are members.

    Null members and keys tie nothing; repeated rows count once; an empty table gives an empty one."""
    ties = ties.select("member_id", "key").where("member_id is not null and key is not null")
    keys = ties.groupBy("key").agg(F.min("member_id").alias("v"), F.count("*").alias("n"))
    edges = cut(lookup_join(ties, keys.where("n > 1"), "key", "n", "v").where("member_id <> v").select(F.col("member_id").alias("u"), "v").distinct())
    found = cut(members.select("member_id").where("member_id is not null").distinct().withColumn("root_id", F.col("member_id")))
    for _ in range(most_rounds):
        if edges.isEmpty():
            return found.select("member_id", "root_id")
        both = edges.select(F.col("u").alias("node"), F.col("v").alias("o")).unionAll(edges.select(F.col("v").alias("node"), F.col("u").alias("o")))
        pointers = cut(both.groupBy("node").agg(F.least(F.min("o"), F.col("node")).alias("to")))
        while True:
            moved = cut(_follow(pointers.withColumn("was", F.col("to")), "to", pointers))
            pointers = moved.select("node", "to")
            if moved.where("was <> to").isEmpty():
                break
        found = cut(_follow(found, "root_id", pointers))
        moved = _follow(_follow(edges, "u", pointers), "v", pointers).where("u <> v")
        edges = cut(moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
