"""Queries of the corpus operations, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, consensus, cosine, pii, refine, splits, subjects, suffixes


#: Key of the surrogates in the queries.
KEY = "demonstration key"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Val and test members that share a company, a text or nearly a text with the train part."""
    return cosine.overlaps(table(spark, sf_dir, "dedup_member"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps counted by part and jurisdiction."""
    members = table(spark, sf_dir, "dedup_member")
    return cosine.report(members, cosine.overlaps(members))


def p1_near_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the texts of the test part alone that have a text of the train part with 0.95 of their trigrams in common."""
    return cosine.near_rate(table(spark, sf_dir, "dedup_member"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that differ only in writing or order, each with the first of its group."""
    found = refine.member_copies(table(spark, sf_dir, "dedup_member"))
    return found.where("member_id <> first_id").select("first_id", F.col("member_id").alias("copy_id"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a group, with its number of copies."""
    found = refine.member_copies(table(spark, sf_dir, "dedup_member"))
    return found.where("member_id = first_id").select("first_id", F.col("n_copies").cast("bigint").alias("n_copies"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agreed label of each item and question."""
    items, _ = consensus.consensus(table(spark, sf_dir, "gold"))
    return items.where("label is not null").select("item_id", "question", "label")


def p3_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each annotator's reliability by question."""
    _, trust = consensus.consensus(table(spark, sf_dir, "gold"))
    return trust.select("annotator", "question", F.round("reliability", 6).alias("reliability"), F.col("n_items").cast("bigint").alias("n_items"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members tied to a smaller one, each with the smallest of its tied set."""
    found = splits.split_members(table(spark, sf_dir, "dedup_member"), table(spark, sf_dir, "item"))
    return found.where("member_id <> root_id and split is not null").select("root_id", "member_id")


def p5_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every member (rows only: any split within the bounds of p5_whole will do)."""
    return splits.split_members(table(spark, sf_dir, "dedup_member"), table(spark, sf_dir, "item")).select("member_id", "root_id", "split")


def p5_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and components summed over the splits (a component in two splits would count twice), and whether the size of every
    split is within a hundredth of its share, and the largest component, of all members."""
    found = splits.split_members(table(spark, sf_dir, "dedup_member"), table(spark, sf_dir, "item"))
    sizes = found.groupBy("root_id", "split").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("n"), F.count("*").alias("c"), F.max("n").alias("largest"))
    want = F.coalesce(*[F.when(F.col("split") == s, F.lit(p)) for s, p in splits.SHARES])
    whole = sizes.agg(F.sum("n").alias("n_members"), F.sum("c").alias("n_components"), F.max("largest").alias("largest"), F.sort_array(F.collect_list(F.struct("n", want.alias("want")))).alias("all"))
    near = F.forall("all", lambda x: F.abs(x.getField("n") - x.getField("want") * F.col("n_members")) <= 0.01 * F.col("n_members") + F.col("largest"))
    return whole.select("n_members", "n_components", near.alias("within"))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the splits and of the labels in them."""
    members = table(spark, sf_dir, "dedup_member")
    found = splits.split_members(members, table(spark, sf_dir, "item"))
    rows = found.join(members.select("member_id", "jurisdiction", "has_text"), "member_id")
    return rows.groupBy("split", "jurisdiction").agg(F.count("*").alias("n_members"), F.count_if("has_text").alias("n_text"), F.countDistinct("root_id").alias("n_components"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of personal data, each with its surrogate settled."""
    return pii.mentions(table(spark, sf_dir, "no_record"), KEY).where("surrogate is not null").select("record_id", "field_name", "kind", "start_pos", "end_pos")


def p6_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with every mention replaced by a placeholder."""
    return pii.masked(table(spark, sf_dir, "no_record"), KEY)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and held-out items that have twelve consecutive words in common."""
    return suffixes.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_item")).select("doc_id", "item_id")


def p8_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest verbatim match of each such pair."""
    return suffixes.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_item"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the affected ones, counted by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    kept = suffixes.without_leaks(docs, suffixes.leaks(docs, table(spark, sf_dir, "heldout_item")))
    return kept.groupBy("source").agg(F.count("*").alias("n_docs"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.assign(*(table(spark, sf_dir, t) for t in ("documents", "subject_label", "subject_area")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that three or more sentences of a document deal with."""
    return _subjects(spark, sf_dir).select("doc_id", "subject").distinct()


def p9_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by subject and language."""
    langs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    return _subjects(spark, sf_dir).join(langs, "doc_id").groupBy("subject", "lang").agg(F.countDistinct("doc_id").alias("n_docs"), F.sum("n_sentences").alias("n_sentences"))


_WORDS = "list_aggregate(regexp_extract_all(replace(lower(nfc_normalize(coalesce({0}, ''))), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+'), 'string_agg', ' ')"
_P2_GROUPS = f"""
WITH m AS (
  SELECT member_id, jurisdiction AS j, request.state.legal_form AS f,
         coalesce({_WORDS.format("signature_key")}, '') AS s, coalesce({_WORDS.format("procuration_key")}, '') AS p,
         list_sort(list_transform(coalesce(request.state.roles, []), lambda x: x.role || ':' || x.count)) AS r
  FROM dedup_member WHERE has_text),
g AS (SELECT *, min(member_id) OVER w AS first_id, count(*) OVER w AS n_copies FROM m WINDOW w AS (PARTITION BY j, f, s, p, r))
"""
_P3 = """
WITH c AS (
  SELECT DISTINCT ON (item_id, a) item_id, a, skipped, rule_type, min_signers, ambiguity
  FROM (SELECT *, replace(lower(trim(regexp_replace(annotator, '[\\s_\\-]+', ' ', 'g'))), ' ', '_') AS a FROM gold)
  WHERE item_id IS NOT NULL AND a IS NOT NULL ORDER BY item_id, a, seq DESC),
v AS (
  SELECT item_id, 'rule_type' AS question, rule_type AS x FROM c WHERE NOT coalesce(skipped, false)
  UNION ALL SELECT item_id, 'min_signers', min_signers FROM c WHERE NOT coalesce(skipped, false)
  UNION ALL SELECT item_id, 'ambiguity', CASE WHEN ambiguity BETWEEN 0 AND 3 THEN CAST(ambiguity AS VARCHAR) END FROM c WHERE NOT coalesce(skipped, false)),
n AS (
  SELECT item_id, question, replace(replace(lower(trim(regexp_replace(x, '[\\s_\\-]+', ' ', 'g'))), ' ', '_'), '_+', '+') AS label, count(*) AS k
  FROM v WHERE x IS NOT NULL GROUP BY ALL),
r AS (SELECT *, sum(k) OVER (PARTITION BY item_id, question) AS total,
             max(k) OVER (PARTITION BY item_id, question) AS top FROM n)
SELECT item_id, question, min(label) AS label FROM r WHERE k = top AND total >= 2 GROUP BY item_id, question HAVING count(*) = 1
"""


_NUMBER = """CASE WHEN regexp_replace(entity_id, '[^0-9]', '', 'g') = '' THEN NULL
  WHEN jurisdiction = 'AT' THEN regexp_replace(regexp_replace(entity_id, '[^0-9]', '', 'g'), '^0+([0-9])', '\\1') || lower(regexp_extract(entity_id, '[0-9][^0-9A-Za-z]*([A-Za-z])[^0-9]*$', 1))
  WHEN jurisdiction IN ('NO', 'DK') THEN regexp_replace(entity_id, '[^0-9]', '', 'g') END"""
_P1 = f"""
WITH m AS (
  SELECT member_id, part_name = 'train' AS is_train, jurisdiction || '|' || ({_NUMBER}) AS e, coalesce(has_text, false) AS has_text,
         coalesce({_WORDS.format("signature_key")}, '') || '|' || coalesce({_WORDS.format("procuration_key")}, '') AS t
  FROM dedup_member),
x AS (SELECT DISTINCT t, is_train FROM m WHERE has_text),
g AS (SELECT t, is_train, list_distinct(list_transform(range(1, length(t) + 3), lambda i: substr('  ' || t || '  ', i, 3))) AS g FROM x),
q AS (SELECT * FROM g WHERE NOT is_train AND t NOT IN (SELECT t FROM g WHERE is_train)),
n AS (
  SELECT DISTINCT q.t FROM q JOIN g b ON b.is_train AND 5 * least(len(q.g), len(b.g)) >= 4 * greatest(len(q.g), len(b.g))
  WHERE 5 * len(list_intersect(q.g, b.g)) >= 4 * (len(q.g) + len(b.g) - len(list_intersect(q.g, b.g))))
SELECT member_id, 'entity' AS kind FROM m WHERE NOT is_train AND e IN (SELECT e FROM m WHERE is_train AND e IS NOT NULL)
UNION ALL SELECT member_id, 'exact' FROM m WHERE NOT is_train AND has_text AND t IN (SELECT t FROM x WHERE is_train)
UNION ALL SELECT member_id, 'near' FROM m WHERE NOT is_train AND has_text AND t IN (SELECT t FROM n)
"""
_P1_RATE = f"""
WITH m AS (
  SELECT part_name, coalesce({_WORDS.format("signature_key")}, '') || '|' || coalesce({_WORDS.format("procuration_key")}, '') AS t
  FROM dedup_member WHERE has_text AND part_name IS NOT NULL),
x AS (SELECT t, bool_or(part_name = 'train') AS is_train, bool_and(part_name = 'test') AS is_test FROM m GROUP BY t),
g AS (SELECT t, is_train, is_test, list_distinct(list_transform(range(1, length(t) + 3), lambda i: substr('  ' || t || '  ', i, 3))) AS g FROM x WHERE is_train OR is_test),
n AS (
  SELECT DISTINCT q.t FROM g q JOIN g b ON q.is_test AND b.is_train AND 20 * least(len(q.g), len(b.g)) >= 19 * greatest(len(q.g), len(b.g))
  WHERE 20 * len(list_intersect(q.g, b.g)) >= 19 * (len(q.g) + len(b.g) - len(list_intersect(q.g, b.g)))),
c AS (SELECT (SELECT count(*) FROM g WHERE is_test) AS n_texts, (SELECT count(*) FROM n) AS n_near)
SELECT n_texts, n_near, round(coalesce(n_near / nullif(n_texts, 0), 0.0), 6) AS near_dup_rate FROM c
"""
_P5 = f"""
WITH RECURSIVE k AS (
  SELECT member_id AS m, 'r|' || jurisdiction || '|' || ({_NUMBER}) AS k FROM dedup_member
  UNION SELECT member_id, 'c|' || cluster FROM dedup_member WHERE cluster <> ''
  UNION SELECT member_id, 'g|' || grp FROM item JOIN dedup_member USING (rid)),
t AS (SELECT DISTINCT a.m AS a, b.m AS b FROM k a JOIN k b USING (k)),
r AS (SELECT a, b FROM t UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a)
"""
_P8_WINDOWS = """
  SELECT id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS k
  FROM (SELECT {id} AS id, regexp_extract_all(replace(lower(nfc_normalize(coalesce(text, ''))), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}) WHERE len(w) >= 12
"""
_P8 = f"""
WITH d AS ({_P8_WINDOWS.format(id="doc_id", table="documents")}), i AS ({_P8_WINDOWS.format(id="item_id", table="heldout_item")})
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM d JOIN i USING (k)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p1_near_rate": _P1_RATE,
        "p5_found": _P5 + "SELECT min(b) AS root_id, a AS member_id FROM r GROUP BY a HAVING min(b) < a",
        "p5_whole": _P5 + "SELECT (SELECT count(*) FROM dedup_member) AS n_members, (SELECT count(*) FROM dedup_member) - count(*) AS n_components, true AS within FROM (SELECT a FROM r GROUP BY a HAVING min(b) < a)",
        "p8_found": _P8,
        "p2_found": _P2_GROUPS + "SELECT first_id, member_id AS copy_id FROM g WHERE member_id <> first_id",
        "p2_groups": _P2_GROUPS + "SELECT DISTINCT first_id, n_copies FROM g WHERE n_copies > 1",
        "p3_found": _P3,
    }
