"""Queries that curate records: groups, votes, splits, leaks, samples, strata, current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.text import text_key
from ..operators import curate, current
from ..session import table
from .registry import Registry

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql

_BLANKS = "[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200B}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+"
_TEXT_KEY = f"regexp_replace(regexp_replace(trim(regexp_replace(replace(lower(nfc_normalize(coalesce({{0}}, ''))), 'ß', 'ss'), '{_BLANKS}', ' ', 'g')), '[‐‑‒–—―−]', '-', 'g'), '[\\s.]+$', '')"
_ROLES = "coalesce(array_to_string(list_transform(list_sort(list_transform(request.state.roles, lambda r: {'role': r.role, 'count': r.count})), lambda r: r.role || ':' || r.count), ';'), '')"


def _digest(*parts: str) -> str:
    return "substr(sha256(" + " || chr(31) || ".join(f"coalesce({p}, '')" for p in parts) + "), 1, 16)"


_MEMBERS = f"""WITH m0 AS (SELECT member_id, entity_id, part_name, registered, coalesce(has_text, false) AS has_text, jurisdiction, request.state.legal_form AS form,
  {_TEXT_KEY.format("signature_key")} AS sig, {_TEXT_KEY.format("procuration_key")} AS prok, {_ROLES} AS roles, request.questions AS questions FROM dedup_member),
m AS (SELECT *, CASE WHEN sig <> '' OR prok <> '' THEN {_digest("jurisdiction", "sig", "prok")} ELSE {_digest("jurisdiction", "form", "sig", "prok", "roles")} END AS text_cluster,
  {_digest("jurisdiction", "form", "sig", "prok", "roles")} AS group_key FROM m0)"""
_HASH01 = "(CAST('0x' || substr(sha256({0}), 1, 8) AS BIGINT) / 4294967295.0)"


def _split(key: str, a: float = 0.8, b: float = 0.9) -> str:
    h = _HASH01.format(f"'13:' || {key}")
    return f"CASE WHEN {h} < {a} THEN 'train' WHEN {h} < {b} THEN 'val' ELSE 'test' END"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.member_rows(table(spark, sf_dir, "dedup_member"))


@R.add("@m SELECT group_key, min(member_id) AS first_member, count(*) AS n_duplicates, min(text_cluster) AS cluster FROM m GROUP BY group_key", m=_MEMBERS)
def dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal records with their number of duplicates and their cluster."""
    r = _rows(spark, sf_dir)
    return r.groupBy("group_key").agg(F.min("member_id").alias("first_member"), F.count("*").alias("n_duplicates"), F.min("text_cluster").alias("cluster"))


_VOTES = """, v AS (SELECT @k AS k, u.q.key AS qid, u.q.value.label AS label FROM m, unnest(map_entries(questions)) u(q)),
n AS (SELECT k, qid, label, count(*) AS n FROM v WHERE label IS NOT NULL GROUP BY ALL),
w AS (SELECT *, max(n) OVER p AS top, sum(n) OVER p AS total FROM n WINDOW p AS (PARTITION BY k, qid)),
t AS (SELECT k, qid, min(label) AS label, min(n) AS votes, CAST(min(total) - min(n) AS BIGINT) AS conflicts FROM w WHERE n = top GROUP BY k, qid HAVING count(*) = 1)"""


@R.add("@m@v SELECT k AS group_key, qid, label, votes, conflicts FROM t", m=_MEMBERS, v=_VOTES.replace("@k", "group_key"))
def dedup_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority label of each group and question; ties are masked."""
    return curate.majority_labels(_rows(spark, sf_dir), "group_key")


@R.add("@m@v SELECT k AS cluster, qid, label, votes, conflicts FROM t", m=_MEMBERS, v=_VOTES.replace("@k", "text_cluster"))
def cluster_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over clusters of equal text, where labels disagree more often."""
    return curate.majority_labels(_rows(spark, sf_dir), "text_cluster").withColumnRenamed("text_cluster", "cluster")


@R.add("@m, v AS (SELECT u.q.key AS qid, u.q.value.label AS label FROM m, unnest(map_entries(questions)) u(q)) SELECT qid, label, count(*) AS n FROM v GROUP BY ALL", m=_MEMBERS)
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _rows(spark, sf_dir).select(F.explode("questions").alias("qid", "q"))
    return q.groupBy("qid", F.col("q.label").alias("label")).agg(F.count("*").alias("n"))


@R.add(f"@m SELECT part, count(DISTINCT text_cluster) AS n_clusters, count(*) AS n_members FROM (SELECT *, {_split('text_cluster')} AS part FROM m) GROUP BY part", m=_MEMBERS)
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a hash split by cluster."""
    r = _rows(spark, sf_dir).withColumn("part", K.hash_split(F.col("text_cluster")))
    return r.groupBy("part").agg(F.countDistinct("text_cluster").alias("n_clusters"), F.count("*").alias("n_members"))


@R.add(f"SELECT doc_id, {_split('doc_id')} AS part FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each document by a hash of its id."""
    return table(spark, sf_dir, "documents").select("doc_id", K.hash_split(F.col("doc_id")).alias("part"))


@R.add(f"""@m, c AS (SELECT text_cluster, bool_and(coalesce(registered >= DATE '2022-01-01', false)) AS all_new, count(*) AS n, count_if(coalesce(registered >= DATE '2022-01-01', false)) AS n_new FROM m GROUP BY ALL)
SELECT text_cluster AS cluster, CASE WHEN all_new THEN 'test' WHEN {_split('text_cluster', 0.9, 1.0)} = 'val' THEN 'val' ELSE 'train' END AS part, n, CASE WHEN all_new THEN 0 ELSE n_new END AS n_new_in_old FROM c""", m=_MEMBERS)  # fmt: skip
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that are new as a whole become the test part."""
    out = curate.temporal_parts(_rows(spark, sf_dir), "text_cluster", "registered", "2022-01-01")
    return out.select(F.col("text_cluster").alias("cluster"), "part", "n", F.col("n_new_in_old").cast("bigint").alias("n_new_in_old"))


@R.add("@m SELECT entity_id AS key, list_sort(list(DISTINCT part_name)) AS parts FROM m WHERE entity_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT part_name) > 1", m=_MEMBERS)
def entity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that occur in more than one part."""
    return curate.overlap(_rows(spark, sf_dir), F.col("entity_id"), "part_name")


@R.add("@m SELECT sig || '|' || prok AS key, list_sort(list(DISTINCT part_name)) AS parts FROM m WHERE has_text GROUP BY 1 HAVING count(DISTINCT part_name) > 1", m=_MEMBERS)
def text_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of texts that occur in more than one part."""
    return curate.overlap(_rows(spark, sf_dir).where("has_text"), F.concat_ws("|", "sig", "prok"), "part_name")


@R.add("""@m SELECT 'entities in several parts' AS name, (SELECT count(*) FROM (SELECT 1 FROM m WHERE entity_id IS NOT NULL GROUP BY entity_id HAVING count(DISTINCT part_name) > 1)) AS value
UNION ALL SELECT 'texts in several parts', (SELECT count(*) FROM (SELECT 1 FROM m WHERE has_text GROUP BY sig, prok HAVING count(DISTINCT part_name) > 1))
UNION ALL SELECT 'members with an e-mail address', (SELECT count(*) FROM m WHERE regexp_matches(sig || ' ' || prok, '[\\w.+-]+@[\\w-]+\\.[\\w.]+'))
UNION ALL SELECT 'members without labels', (SELECT count(*) FROM m WHERE coalesce(cardinality(questions), 0) = 0)""", m=_MEMBERS)  # fmt: skip
def data_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that a data check compares with zero."""
    r = _rows(spark, sf_dir)
    rows = [
        ("entities in several parts", curate.overlap(r, F.col("entity_id"), "part_name")),
        ("texts in several parts", curate.overlap(r.where("has_text"), F.struct("sig", "prok"), "part_name")),
        ("members with an e-mail address", r.where(F.concat_ws(" ", "sig", "prok").rlike(r"[\w.+-]+@[\w-]+\.[\w.]+"))),
        ("members without labels", r.where(F.coalesce(F.size("questions"), F.lit(0)) <= 0)),
    ]
    out = None
    for name, found in rows:
        one = found.agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), "value")
        out = one if out is None else out.unionAll(one)
    return out


@R.add(f"""WITH k AS (SELECT doc_id, source, {_TEXT_KEY.format("text")} AS k FROM documents),
n AS (SELECT *, CASE WHEN k = '' THEN 0 ELSE count(*) OVER (PARTITION BY k) END AS same FROM k)
SELECT source, CASE WHEN same >= 2 THEN 'standard' ELSE 'tail' END AS stratum, count(*) AS n FROM n GROUP BY ALL""")
def strata_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text occurs at least twice are standard, all others tail; counted without a window over hot texts."""
    d = table(spark, sf_dir, "documents").select("source", text_key(F.col("text")).alias("k"))
    n = d.groupBy("k", "source").agg(F.count("*").alias("n"))
    same = n.groupBy("k").agg(F.when(F.col("k") == "", 0).otherwise(F.sum("n")).alias("same"))
    return n.join(same, "k").groupBy("source", F.when(F.col("same") >= 2, "standard").otherwise("tail").alias("stratum")).agg(F.sum("n").alias("n"))


@R.add("""SELECT CASE WHEN n_chars IS NULL THEN 'none' WHEN n_chars < 20 THEN '<20' WHEN n_chars < 80 THEN '<80' WHEN n_chars < 320 THEN '<320' WHEN n_chars < 640 THEN '<640' ELSE '>=640' END AS strict,
CASE WHEN n_chars IS NULL THEN 'none' WHEN n_chars <= 50 THEN '<=50' WHEN n_chars <= 400 THEN '<=400' ELSE '>400' END AS inclusive, count(*) AS n FROM documents GROUP BY ALL""")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").groupBy(K.bucket(n, [20, 80, 320, 640]).alias("strict"), K.bucket(n, [50, 400], inclusive=True).alias("inclusive")).agg(F.count("*").alias("n"))


_UH = _HASH01.format("'13:' || {0}")


@R.add(f"""WITH t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_UH.format('doc_id')}, doc_id) AS turn FROM documents)
SELECT doc_id, source, CAST(turn AS INT) AS turn FROM t ORDER BY turn, coalesce(source, ''), doc_id LIMIT 100""")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents, one of each source in turn (a sampling operator)."""
    return curate.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 100)


@R.add(f"""WITH t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_UH.format('doc_id')}, doc_id) AS turn FROM documents WHERE source IN ('press_note', 'statutes', 'help_page')),
b AS (SELECT *, greatest(turn - CASE source WHEN 'press_note' THEN 10 WHEN 'statutes' THEN 20 ELSE 5 END, 0) AS beyond FROM t WHERE turn <= 35)
SELECT doc_id, source FROM b ORDER BY beyond, source, turn LIMIT 35""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas by source, made up from the others where one falls short (a sampling operator)."""
    return curate.quota_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", {"press_note": 10, "statutes": 20, "help_page": 5}).select("doc_id", "source")


@R.add(f"SELECT doc_id FROM documents ORDER BY {_UH.format('doc_id')}, doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50)


@R.add("""WITH k AS (SELECT lower(regexp_replace(coalesce(text, ''), '\\d+', '<N>', 'g')) AS t, publisher_id FROM documents),
g AS (SELECT t, count(DISTINCT publisher_id) AS e, count(*) AS n FROM k GROUP BY t)
SELECT CASE WHEN e >= 2 THEN t ELSE '<rare>' END AS template, CAST(sum(e) AS BIGINT) AS n_entities, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_templates FROM g GROUP BY 1""")
def shared_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several publishers share, numbers aside; all others as one row."""
    d = table(spark, sf_dir, "documents").select(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"\d+", "<N>")).alias("t"), "publisher_id")
    return curate.k_anonymous(d, "t", "publisher_id", 2)


@R.add("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\\p{L}])([A-ZÆØÅÄÖÜ]\\p{L}+)', 1)) AS word FROM documents WHERE text IS NOT NULL)
SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 100""")
def capitalised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred capitalised words that most documents have (a report)."""
    w = table(spark, sf_dir, "documents").where("text is not null").select(F.explode(F.array_distinct(F.expr(r"regexp_extract_all(text, '(?:^|[^\\p{L}])([A-ZÆØÅÄÖÜ]\\p{L}+)', 1)"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


@R.add("""WITH l AS (SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, value FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC) SELECT * FROM l""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type, without a sort."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return current.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@R.add("""WITH p AS (SELECT event_id, user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events)
SELECT event_id, user_id, event_type FROM p WHERE until IS NULL""")
def open_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that open a period which is still open: the last of each user, without a window over hot users."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return current.latest(e, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@R.add("""WITH d AS (SELECT item_id, a, seq, skipped, rule_type FROM (SELECT *, lower(trim(replace(annotator, '_', '-'))) AS a, row_number() OVER (PARTITION BY item_id, lower(trim(replace(annotator, '_', '-'))) ORDER BY seq DESC) AS k FROM gold) WHERE k = 1)
SELECT item_id, a AS annotator, seq FROM d WHERE NOT skipped""")
def current_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each item and annotator, left out if it is skipped."""
    g = table(spark, sf_dir, "gold").select("item_id", F.lower(F.trim(F.replace("annotator", F.lit("_"), F.lit("-")))).alias("annotator"), "seq", "skipped")
    return current.latest(g, ["item_id", "annotator"], ["seq"], "not skipped").select("item_id", "annotator", "seq")


@R.add("""WITH x AS (SELECT u.q.key AS qid, m.rid, u.q.value.type AS qtype, u.q.value.label AS label, has_text FROM dedup_member m, unnest(map_entries(request.questions)) u(q)) SELECT qid, qtype, has_text, count(*) AS n, count(label) AS n_labelled FROM x GROUP BY ALL""")
def items_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of requests as items."""
    q = table(spark, sf_dir, "dedup_member").select("has_text", F.explode("request.questions").alias("qid", "q"))
    return q.groupBy("qid", F.col("q.type").alias("qtype"), "has_text").agg(F.count("*").alias("n"), F.count("q.label").alias("n_labelled"))


@R.add("""SELECT member_id, coalesce(array_to_string(list_transform(list_sort(list_transform(request.state.roles, lambda r: {'role': r.role, 'count': r.count})), lambda r: r.role || '=' || r.count), ' '), '') AS roles,
'[' || coalesce(request.state.legal_form, '') || '] S: ' || coalesce(request.state.signature_rule, '') || ' P: ' || coalesce(request.state.procuration_rule, '') AS head FROM dedup_member""")
def state_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request's state as one line of text."""
    s = F.col("request.state")
    roles = F.array_join(F.transform(F.array_sort(s.getField("roles")), lambda r: F.concat_ws("=", r.role, r.getField("count").cast("string"))), " ")
    n = lambda c: F.coalesce(s.getField(c), F.lit(""))
    return table(spark, sf_dir, "dedup_member").select("member_id", F.coalesce(roles, F.lit("")).alias("roles"), F.concat(F.lit("["), n("legal_form"), F.lit("] S: "), n("signature_rule"), F.lit(" P: "), n("procuration_rule")).alias("head"))


@R.add("SELECT count(*) AS n_rows, CAST(sum(greatest(1, round_even(sqrt(c), 0))) AS BIGINT) AS n_repeated FROM (SELECT cluster, count(*) AS c FROM dedup_member WHERE cluster <> '' GROUP BY cluster)")
def oversample_sqrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows repeated by the root of their number of duplicates."""
    c = table(spark, sf_dir, "dedup_member").where("cluster <> ''").groupBy("cluster").agg(F.count("*").alias("c"))
    rep = c.select("cluster", F.explode(F.sequence(F.lit(1), K.repeats(F.col("c")))).alias("i"))
    return rep.agg(F.countDistinct("cluster").alias("n_rows"), F.count("*").alias("n_repeated"))


@R.add("""SELECT 'with orders' AS name, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'without orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'in both', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'in either', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)""")
def set_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi- and anti-joins and set operations on ids."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    parts = {"with orders": c.join(o, "c_custkey", "left_semi"), "without orders": c.join(o, "c_custkey", "left_anti"), "in both": c.intersect(o), "in either": c.union(o).distinct()}
    out = None
    for name, d in parts.items():
        one = d.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@R.add("""SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS BIGINT))::BIGINT AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan with a pushed filter and one partial aggregation."""
    t = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@R.add("""WITH o AS (SELECT o_custkey, o_orderpriority, bool_and(o_orderdate >= TIMESTAMP '1998-01-01') AS all_new, count(*) AS n FROM orders GROUP BY ALL)
SELECT CASE WHEN all_new THEN 'test' ELSE 'old' END AS part, count(*) AS n_clusters, CAST(sum(n) AS BIGINT) AS n_orders FROM o GROUP BY 1""")
def temporal_split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.min(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(new.alias("all_new"), F.count("*").alias("n"))
    return o.groupBy(F.when(F.col("all_new"), "test").otherwise("old").alias("part")).agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_orders"))


@R.add("""SELECT n_name, r_name, count(*) AS n_customers, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left outer and inner joins with small dimensions, which Spark broadcasts by their size."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    j = c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("n_customers"), F.count("o_orderkey").alias("n_orders"))


@R.add("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL""")
def daily_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and distinct users by day."""
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


@R.add("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY user_id""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a gap of thirty minutes."""
    e = table(spark, sf_dir, "events").select("user_id", "ts").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return e.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


@R.add("""WITH p AS (SELECT unnest(json_keys(props)) AS path, props FROM events WHERE props IS NOT NULL) SELECT path, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || path)) AS n_values FROM p GROUP BY path""")
def props_key_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key paths of JSON properties and how many values each has."""
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").where("props is not null").select(F.explode(m).alias("path", "v")).groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("v").alias("n_values"))
