"""Groups of equal records, majority labels, strata, splits and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import cluster_key, hash_split, roles_signature, unit_hash
from ..functions.text import text_key


def member_rows(members: DataFrame) -> DataFrame:
    """Members with the parts of their group key and with their cluster: texts decide it, or the whole key where there is no text."""
    state = F.col("request.state")
    m = members.select(
        "member_id", "entity_id", "part_name", "registered", F.coalesce("has_text", F.lit(False)).alias("has_text"),
        "jurisdiction", state.getField("legal_form").alias("form"), text_key(F.col("signature_key")).alias("sig"), text_key(F.col("procuration_key")).alias("prok"),
        roles_signature(F.array_sort(state.getField("roles"))).alias("roles"), F.col("request.questions").alias("questions"),
    )
    whole = cluster_key(*[F.col(c) for c in ("jurisdiction", "form", "sig", "prok", "roles")])
    return m.withColumn("text_cluster", F.when((F.col("sig") != "") | (F.col("prok") != ""), cluster_key(F.col("jurisdiction"), F.col("sig"), F.col("prok"))).otherwise(whole)).withColumn("group_key", whole)


def majority_labels(rows: DataFrame, key: str, questions: str = "questions") -> DataFrame:
    """(key, qid, label, votes, conflicts) of every group and question: the label with most votes; a tie masks it (no row).

    Votes are counted with partial aggregation; only counts reach the second step. Null labels are no votes."""
    votes = rows.select(key, F.explode(questions).alias("qid", "q")).where("q.label is not null").groupBy(key, "qid", F.col("q.label").alias("label")).agg(F.count("*").alias("n"))
    per = votes.groupBy(key, "qid").agg(F.max(F.struct("n", "label")).alias("best"), F.sum("n").alias("total"), F.max("n").alias("top"), F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    single = (F.size("ns") == 1) | (F.get("ns", F.lit(0)) > F.coalesce(F.get("ns", F.lit(1)), F.lit(0)))
    return per.where(single).select(key, "qid", F.col("best.label").alias("label"), F.col("top").alias("votes"), (F.col("total") - F.col("top")).alias("conflicts"))


def temporal_parts(rows: DataFrame, cluster: str, registered: str, cutoff: str) -> DataFrame:
    """(cluster, part, n, n_new_in_old): test if every member is from the cutoff on, a null date not being so; else val or train by hash."""
    new = F.coalesce(F.col(registered) >= F.lit(cutoff).cast("date"), F.lit(False))
    per = rows.groupBy(cluster).agg(F.min(new).alias("all_new"), F.count("*").alias("n"), F.count_if(new).alias("n_new"))
    h = hash_split(F.col(cluster), (0.9, 0.1, 0.0))
    part = F.when(F.col("all_new"), "test").when(h == "val", "val").otherwise("train")
    return per.select(cluster, part.alias("part"), "n", F.when(F.col("all_new"), 0).otherwise(F.col("n_new")).alias("n_new_in_old"))


def overlap(rows: DataFrame, key: Column, part: str) -> DataFrame:
    """(key, parts): keys that occur in more than one part."""
    per = rows.select(key.alias("key"), part).where("key is not null").groupBy("key").agg(F.sort_array(F.collect_set(part)).alias("parts"))
    return per.where(F.size("parts") > 1)


def k_anonymous(rows: DataFrame, template: str, entity: str, k: int) -> DataFrame:
    """(template, n_entities, n_rows) of templates that at least k entities share; all others as one row '<rare>'."""
    per = rows.groupBy(template).agg(F.countDistinct(entity).alias("n_entities"), F.count("*").alias("n_rows"))
    shown = F.when(F.col("n_entities") >= k, F.col(template)).otherwise("<rare>")
    return per.withColumn("template", shown).groupBy("template").agg(F.sum("n_entities").alias("n_entities"), F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_templates"))


def round_robin(rows: DataFrame, stratum: str, id: str, n: int, seed: int = 13) -> DataFrame:
    """n rows, one from each stratum in turn, in hash order inside a stratum."""
    order = [unit_hash(F.lit(seed), F.col(id)), F.col(id)]
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    # No stratum gives more than n rows, which the window's group limit applies before the shuffle.
    return rows.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", F.coalesce(stratum, F.lit("")), id).limit(n)


def quota_sample(rows: DataFrame, stratum: str, id: str, quotas: dict[str, int], seed: int = 13) -> DataFrame:
    """Rows of each stratum up to its quota; what a stratum lacks is made up from the others in turn. Strata without a quota have none."""
    want = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    total = sum(quotas.values())
    order = [unit_hash(F.lit(seed), F.col(id)), F.col(id)]
    r = rows.where(F.col(stratum).isin(list(quotas))).withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("turn") <= total)
    q = F.try_element_at(want, F.col(stratum))
    beyond = F.greatest(F.col("turn") - q, F.lit(0))
    return r.withColumn("beyond", beyond).orderBy("beyond", stratum, "turn").limit(total)


def hash_sample(rows: DataFrame, id: str, n: int, seed: int = 13) -> DataFrame:
    """n rows without replacement, the first in hash order."""
    return rows.orderBy(unit_hash(F.lit(seed), F.col(id)), id).limit(n)
