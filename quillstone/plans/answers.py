"""Queries over answers: blocks of metrics, policies, merged and adjudicated answers, buckets, patterns seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import privacy
from ..operators import evaluate, metrics, ontology, registers, requests
from ..session import table
from .evaluation import _SCORED
from .registry import Registry

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql

#: Versions of the probabilities: as they are, and flattened.
VERSIONS = {"raw": 1.0, "tempered": 1.5}


@R.add("""@s, v AS (SELECT s.*, 'raw' AS version, conf AS c, p_gold AS p FROM s UNION ALL
SELECT s.*, 'tempered', pow(conf, 1/1.5) / (pow(conf, 1/1.5) + pow(1 - conf, 1/1.5)), pow(p_gold, 1/1.5) / (pow(p_gold, 1/1.5) + pow(1 - p_gold, 1/1.5)) FROM s),
m AS (SELECT qid, version, count(*) AS n, avg(ok) AS accuracy, avg(-ln(greatest(p, 1e-12))) AS nll, avg((1 - p) * (1 - p)) AS brier FROM v GROUP BY ALL),
e AS (SELECT qid, version, sum(k * abs(a - c)) / sum(k) AS ece FROM (SELECT qid, version, least(greatest(ceil(c * 15) - 1, 0), 14) AS bin, count(*) AS k, avg(ok) AS a, avg(c) AS c FROM v GROUP BY ALL) GROUP BY ALL),
f AS (SELECT qid, version, avg(hits / total) AS macro_f1 FROM (SELECT qid, version, x AS label, sum(2.0 * hit) / 2 AS hits, count(*) AS total FROM
  (SELECT qid, version, y AS x, CASE WHEN y = pred THEN 1 ELSE 0 END AS hit FROM v UNION ALL SELECT qid, version, pred, CASE WHEN y = pred THEN 1 ELSE 0 END FROM v) GROUP BY ALL) GROUP BY ALL)
SELECT qid, version, n, round(accuracy, 6) AS accuracy, round(nll, 6) AS nll, round(brier, 6) AS brier, round(ece, 6) AS ece, round(macro_f1, 6) AS macro_f1 FROM m JOIN e USING (qid, version) JOIN f USING (qid, version)""", s=_SCORED)  # fmt: skip
def evaluate_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of each question, on the probabilities as they are and at a temperature."""
    out = evaluate.evaluate(metrics.scored(table(spark, sf_dir, "item")), ["qid"], VERSIONS)
    return out.select("qid", "version", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "nll", "brier", "ece", "macro_f1")])


@R.add("@s SELECT CASE WHEN qid IN ('ceo_alone', 'chair_alone') THEN 'one signer' WHEN qid LIKE 'prokura%' THEN 'procuration' ELSE 'other' END AS question_set, count(*) AS n, round(sum(ok) / count(*), 6) AS accuracy FROM s GROUP BY 1", s=_SCORED)
def accuracy_of_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over sets of questions, each question weighing by its answers."""
    name = F.when(F.col("qid").isin("ceo_alone", "chair_alone"), "one signer").when(F.col("qid").startswith("prokura"), "procuration").otherwise("other")
    return metrics.scored(table(spark, sf_dir, "item")).groupBy(name.alias("question_set")).agg(F.count("*").alias("n"), F.round(F.sum("ok") / F.count("*"), 6).alias("accuracy"))


@R.add("""WITH a AS (SELECT rid, qid, max(pred) AS p FROM item WHERE pred IS NOT NULL AND rid IS NOT NULL AND qid IS NOT NULL GROUP BY ALL) SELECT rid, string_agg(qid || '=' || p, ';' ORDER BY qid) AS answers FROM a GROUP BY rid""")
def answers_by_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of each request as one map, written in the order of its questions."""
    a = table(spark, sf_dir, "item").where("pred is not null and rid is not null and qid is not null").groupBy("rid", "qid").agg(F.max("pred").alias("p"))
    maps = a.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("qid", "p"))).alias("m"))
    return maps.select("rid", F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda q: F.concat(q, F.lit("="), F.try_element_at("m", q).cast("string"))), ";").alias("answers"))


_POLICIES = """WITH own AS (SELECT DISTINCT upper(split_part(rid, '/', 1)) AS jurisdiction, qtype, conf FROM item WHERE conf IS NOT NULL AND rid LIKE '%/%'),
p AS (SELECT jurisdiction, qtype, round(min(conf), 6) AS threshold FROM own WHERE jurisdiction <> 'DK' GROUP BY ALL),
w AS (SELECT DISTINCT jurisdiction, qtype FROM own), s AS (SELECT qtype, max(threshold) AS strict FROM p GROUP BY qtype)
"""


@R.add(_POLICIES + "SELECT w.jurisdiction, w.qtype, CASE WHEN p.jurisdiction IS NULL THEN strict ELSE threshold END AS threshold, p.jurisdiction IS NULL AS fallback FROM w LEFT JOIN p USING (jurisdiction, qtype) LEFT JOIN s USING (qtype)")
def policy_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds by register (here the least confidence seen), and for a register without any (here DK) the strictest of the others, flagged."""
    i = table(spark, sf_dir, "item").where("conf is not null and rid like '%/%'").select(F.upper(F.split("rid", "/")[0]).alias("jurisdiction"), "qtype", "conf")
    policy = i.where("jurisdiction <> 'DK'").groupBy("jurisdiction", "qtype").agg(F.round(F.min("conf"), 6).alias("threshold"))
    return evaluate.with_fallback(i, policy, "jurisdiction", "qtype")


@R.add("""WITH a AS (SELECT DISTINCT seq, item_id FROM gold WHERE seq IS NOT NULL AND item_id IS NOT NULL), g AS (SELECT seq, min(item_id) AS id, min(rule_type) AS label FROM gold WHERE seq IS NOT NULL AND seq % 3 <> 0 GROUP BY seq),
b AS (SELECT seq, CASE WHEN seq % 7 = 0 THEN 'another' ELSE id END AS id, label FROM g)
SELECT CASE WHEN b.seq IS NULL THEN 'missing' WHEN b.id IS NOT DISTINCT FROM a.item_id THEN 'merged' ELSE 'id differs' END AS status, count(*) AS n, count(CASE WHEN b.id IS NOT DISTINCT FROM a.item_id THEN b.label END) AS n_answers FROM a LEFT JOIN b USING (seq) GROUP BY 1""")  # fmt: skip
def merged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers merged by number where the ids agree, and how many don't fit or are missing; the answers come from the table itself, with a third left out and some ids changed."""
    g = table(spark, sf_dir, "gold").where("seq is not null").select("seq", "item_id", "rule_type")
    asked = g.where("item_id is not null").select("seq", "item_id").distinct()
    given = g.where("seq % 3 <> 0").groupBy("seq").agg(F.min("item_id").alias("item_id"), F.min("rule_type").alias("label"))
    given = given.withColumn("item_id", F.when(F.col("seq") % 7 == 0, "another").otherwise(F.col("item_id")))
    return evaluate.merged(asked, given, "seq", "item_id", "label").groupBy("status").agg(F.count("*").alias("n"), F.count("label").alias("n_answers"))


@R.add("""WITH v AS (SELECT item_id, lower(annotator) AS annotator, max(rule_type) AS label FROM gold WHERE item_id IS NOT NULL AND annotator IS NOT NULL AND rule_type IS NOT NULL GROUP BY ALL),
x AS (SELECT item_id, min(annotator) AS annotator FROM v GROUP BY item_id), n AS (SELECT item_id, min(v.label) AS named FROM v JOIN x USING (item_id, annotator) GROUP BY item_id),
s AS (SELECT item_id, count(*) >= 2 AND min(label) = max(label) AS agree, min(label) AS a FROM v GROUP BY item_id)
SELECT item_id, CASE WHEN agree THEN a ELSE named END AS label, CASE WHEN agree THEN 'agreed' ELSE 'adjudicated' END AS source FROM s JOIN n USING (item_id)""")  # fmt: skip
def adjudicated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label that all annotators of an item gave, else that of its first annotator, who adjudicates."""
    g = table(spark, sf_dir, "gold").where("item_id is not null and annotator is not null and rule_type is not null")
    votes = g.groupBy("item_id", F.lower("annotator").alias("annotator")).agg(F.max("rule_type").alias("label"))
    return evaluate.adjudicated(votes, votes.groupBy("item_id").agg(F.min("annotator").alias("annotator")), ["item_id"])


@R.add("""WITH a AS (SELECT DISTINCT seq, status, person_specific, list_transform(alternatives, lambda g: {'roles': list_transform(g.roles, lambda r: {'role': CASE WHEN r.role = 'EXECUTIVE_MEMBER' THEN 'BOARD_MEMBER' ELSE r.role END, 'n': r.n}), 'collective': g.collective}) AS alts
FROM gold WHERE status = 'rule' AND alternatives IS NOT NULL AND NOT skipped),
n AS (SELECT *, coalesce(person_specific, false) OR len(list_filter(alts, lambda g: list_contains(list_transform(coalesce(g.roles, []), lambda r: r.role), 'SIGNATORY'))) > 0 AS named, list_min(list_transform(alts, lambda g: CASE WHEN g.collective IS NULL THEN list_sum(list_transform(g.roles, lambda r: r.n)) END)) AS least FROM a)
SELECT seq, named, CASE WHEN named THEN '1' WHEN len(alts) = 0 THEN NULL WHEN least IS NULL THEN 'all_board' WHEN least <= 1 THEN '1' WHEN least = 2 THEN '2' ELSE '3+' END AS min_signers FROM n""")  # fmt: skip
def annotation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest signers of annotated rules: members of an executive body count as board members, and a rule with a named signatory needs one."""
    g = table(spark, sf_dir, "gold").where("status = 'rule' and alternatives is not null and not skipped").select("seq", "status", "person_specific", "alternatives").distinct()
    alts = F.transform("alternatives", lambda x: x.withField("roles", F.transform(x.getField("roles"), lambda r: r.withField("role", F.when(r.getField("role") == "EXECUTIVE_MEMBER", "BOARD_MEMBER").otherwise(r.getField("role"))))))
    signatory = F.exists(alts, lambda x: F.coalesce(F.exists(x.getField("roles"), lambda r: r.getField("role") == "SIGNATORY"), F.lit(False)))
    named = F.coalesce("person_specific", F.lit(False)) | signatory
    return g.select("seq", named.alias("named"), F.when(named, "1").otherwise(ontology.min_signers(F.col("status"), alts)).alias("min_signers"))


@R.add("""WITH m AS (SELECT member_id, jurisdiction, list_sum(list_transform(list_filter(coalesce(request.state.roles, []), lambda r: r.role = 'Geschäftsführer'), lambda r: r.count)) AS gf FROM dedup_member)
SELECT jurisdiction, CASE WHEN coalesce(gf, 0) = 0 THEN '0' WHEN gf = 1 THEN '1' WHEN gf = 2 THEN '2' ELSE '3+' END AS bucket, count(*) AS n FROM m GROUP BY ALL""")  # fmt: skip
def manager_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by the number of their managing directors."""
    roles = F.coalesce("request.state.roles", F.array().cast("array<struct<role:string,count:int>>"))
    n = F.aggregate(F.filter(roles, lambda r: r.getField("role") == "Geschäftsführer"), F.lit(0), lambda s, r: s + F.coalesce(r.getField("count").cast("int"), F.lit(0)))
    bucket = F.when(n == 0, "0").when(n == 1, "1").when(n == 2, "2").otherwise("3+")
    return table(spark, sf_dir, "dedup_member").groupBy("jurisdiction", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@R.add("""WITH m AS (SELECT part_name, cluster, signature_key AS k FROM dedup_member WHERE has_text AND signature_key IS NOT NULL), t AS (SELECT DISTINCT k FROM m WHERE part_name = 'train')
SELECT part_name, count(*) AS n, count_if(k IN (SELECT k FROM t)) AS n_seen FROM m WHERE part_name <> 'train' GROUP BY part_name""")
def patterns_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the other parts whose signing text, as it stands, was seen in the train part."""
    m = table(spark, sf_dir, "dedup_member").where("has_text and signature_key is not null").select("part_name", F.col("signature_key").alias("k"))
    counts = m.groupBy("k", "part_name").agg(F.count("*").alias("n"))  # one row a text and part, so that no text is hot
    seen = counts.where("part_name = 'train'").select("k", F.lit(True).alias("seen"))
    return counts.where("part_name <> 'train'").join(seen, "k", "left").groupBy("part_name").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("seen"), F.col("n")).otherwise(0)).alias("n_seen"))


@R.add(None)
def coded_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the codes of extracts state by themselves (rows only)."""
    f = registers.extract_functions(table(spark, sf_dir, "at_extract")).where(F.col("fken").isin(*registers.REPRESENTING))
    return evaluate.coded_rules(f).select("extract_id", F.array_join("offices", ";").alias("offices"), "person_specific")


@R.add(None)
def scrubbed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of records redacted, and every capitalised word that is no word of law or offices as [X] (rows only)."""
    allowed = [w.lower() for w in privacy.LEGAL_WORDS["NO"]]
    return table(spark, sf_dir, "no_record").select("record_id", *[requests.scrub(F.col(c), allowed).alias(c) for c in ("signature_text", "procuration_text")])


@R.add(None)
def personal_key_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in lookup bodies whose key names a personal identifier, with their counts (rows only)."""
    from ..sources.discover import key_paths

    last = F.element_at(F.split("path", r"[.]"), -1)
    return key_paths(table(spark, sf_dir, "fullmakt_signatur_rf"), "body").where(privacy.personal_key(F.regexp_replace(last, r"\[\]", "")))
