"""Queries over scored items: quality, calibration, abstention, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibrate, metrics
from ..operators.current import latest
from ..session import table
from .registry import Registry

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql

_SCORED = """WITH s AS (SELECT *, CAST(y = pred AS INT) AS ok, CAST(y <> pred AS INT) AS err FROM (SELECT DISTINCT * FROM item)
  WHERE y IS NOT NULL AND pred IS NOT NULL AND conf IS NOT NULL)"""
_LAMBDAS = ", ".join(f"({x})" for x in calibrate.LAMBDAS)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.scored(table(spark, sf_dir, "item"))


@R.add("@s SELECT qid, qtype, has_text, count(*) AS n, round(avg(ok), 6) AS accuracy FROM s GROUP BY GROUPING SETS ((qid), (qtype), (qtype, has_text), ())", s=_SCORED)
def accuracy_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by several strata in one pass."""
    out = metrics.accuracy_sets(_items(spark, sf_dir), [["qid"], ["qtype"], ["qtype", "has_text"], []])
    return out.select("qid", "qtype", "has_text", "n", F.round("accuracy", 6).alias("accuracy"))


@R.add("@s SELECT qtype, has_text, count(*) AS n, round(avg(conf), 6) AS mean_conf FROM s GROUP BY CUBE (qtype, has_text)", s=_SCORED)
def confidence_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence over a cube of strata."""
    return _items(spark, sf_dir).cube("qtype", "has_text").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("mean_conf"))


@R.add("@s SELECT qid, y, pred, count(*) AS n FROM s GROUP BY ALL", s=_SCORED)
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_items(spark, sf_dir), ["qid"])


@R.add("""@s, c AS (SELECT qid, y, pred, count(*) AS n FROM s GROUP BY ALL),
x AS (SELECT qid, y AS c, CASE WHEN y = pred THEN n ELSE 0 END AS h, n FROM c UNION ALL SELECT qid, pred, CASE WHEN y = pred THEN n ELSE 0 END, n FROM c),
f AS (SELECT qid, c, sum(h) / sum(n) AS f FROM x GROUP BY ALL)
SELECT qid, round(avg(f), 6) AS macro_f1, count(*) AS n_classes FROM f GROUP BY qid""", s=_SCORED)  # fmt: skip
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro_f1(_items(spark, sf_dir), ["qid"]).select("qid", F.round("macro_f1", 6).alias("macro_f1"), "n_classes")


@R.add("""@s SELECT qtype, round(avg(-ln(greatest(p_gold, 1e-12))), 6) AS nll, round(avg((1 - p_gold) ** 2), 6) AS brier_gold, count(*) AS n
FROM s WHERE p_gold IS NOT NULL GROUP BY qtype""", s=_SCORED)  # fmt: skip
def nll_and_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative log likelihood and squared deviation of the probability of the right answer."""
    s = _items(spark, sf_dir).where("p_gold is not null")
    return s.groupBy("qtype").agg(F.round(F.avg(-F.log(F.greatest("p_gold", F.lit(1e-12)))), 6).alias("nll"), F.round(F.avg(F.pow(1 - F.col("p_gold"), F.lit(2.0))), 6).alias("brier_gold"), F.count("*").alias("n"))


@R.add("""@s, b AS (SELECT qtype, least(greatest(ceil(conf * 15) - 1, 0), 14) AS bin, count(*) AS n, avg(ok) AS a, avg(conf) AS c FROM s GROUP BY ALL)
SELECT qtype, round(sum(n * abs(a - c)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY qtype""", s=_SCORED)  # fmt: skip
def ece_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ece_width(_items(spark, sf_dir), ["qtype"]).select("qtype", F.round("ece", 6).alias("ece"), "n")


@R.add("""@s, t AS (SELECT *, ntile(15) OVER (PARTITION BY qtype ORDER BY conf, rid, qid, pred, p_gold, grp) AS bin FROM s),
b AS (SELECT qtype, bin, count(*) AS n, avg(ok) AS a, avg(conf) AS c FROM t GROUP BY ALL)
SELECT qtype, round(sum(n * abs(a - c)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY qtype""", s=_SCORED)  # fmt: skip
def ece_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ece_mass(_items(spark, sf_dir), ["qtype"]).select("qtype", F.round("ece", 6).alias("ece"), "n")


_CURVE = (
    _SCORED
    + """, c AS (SELECT *, row_number() OVER w AS k, sum(err) OVER w AS cum, count(*) OVER (PARTITION BY qtype) AS n_all FROM s
  WINDOW w AS (PARTITION BY qtype ORDER BY conf DESC, rid, qid, pred, p_gold NULLS FIRST, grp NULLS FIRST ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, k / n_all AS coverage, cum / k AS risk FROM c)"""
)


@R.add("@c SELECT qtype, rid, qid, CAST(k AS BIGINT) AS k, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM r", c=_CURVE)
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = metrics.risk_coverage(_items(spark, sf_dir), ["qtype"])
    return curve.select("qtype", "rid", "qid", F.col("k").cast("bigint").alias("k"), F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@R.add("""@c SELECT qtype, round(avg(risk), 6) AS aurc, count(*) AS n,
  round(coalesce(max(CASE WHEN risk <= 0.02 + 1e-12 THEN coverage END), 0), 6) AS coverage_at_2,
  round(coalesce(max(CASE WHEN risk <= 0.05 + 1e-12 THEN coverage END), 0), 6) AS coverage_at_5,
  round(coalesce(max(CASE WHEN risk <= 0.1 + 1e-12 THEN coverage END), 0), 6) AS coverage_at_10 FROM r GROUP BY qtype""", c=_CURVE)  # fmt: skip
def aurc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the risk-coverage curve and the coverage reached at given risks."""
    s = metrics.curve_summary(metrics.risk_coverage(_items(spark, sf_dir), ["qtype"]), ["qtype"], [0.02, 0.05, 0.1])
    return s.select("qtype", "n", *[F.round(c, 6).alias(c) for c in ("aurc", "coverage_at_2", "coverage_at_5", "coverage_at_10")])


@R.add("""@c, l AS (SELECT DISTINCT qtype, n_all, level, greatest(1, CAST(round_even(level * n_all, 0) AS BIGINT)) AS k FROM r, (SELECT unnest([0.05, 0.1, 0.25, 0.5, 0.75, 1.0]) AS level))
SELECT r.qtype, CAST(level AS DOUBLE) AS level, round(risk, 6) AS risk FROM r JOIN l ON r.qtype = l.qtype AND r.k = l.k""", c=_CURVE)  # fmt: skip
def risk_at_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = metrics.risk_at_levels(metrics.risk_coverage(_items(spark, sf_dir), ["qtype"]), ["qtype"], [0.05, 0.1, 0.25, 0.5, 0.75, 1.0])
    return t.select("qtype", "level", F.round("risk", 6).alias("risk"))


@R.add("""@s SELECT rid, qid, qtype, y, pred, conf FROM (SELECT *, row_number() OVER (ORDER BY conf DESC, rid, qid) AS k FROM s WHERE err = 1) WHERE k <= 50""", s=_SCORED)
def confident_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty most confident errors (a report)."""
    return _items(spark, sf_dir).where("err = 1").orderBy(F.desc("conf"), "rid", "qid").limit(50).select("rid", "qid", "qtype", "y", "pred", "conf")


@R.add("@s SELECT qid, count(*) AS n, count_if(pred = 1 AND y = 0) AS dangerous, round(count_if(pred = 1 AND y = 0) / count(*), 6) AS rate FROM s WHERE qtype = 'noul' GROUP BY qid", s=_SCORED)
def dangerous_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes said where the answer is no."""
    d = F.count_if((F.col("pred") == 1) & (F.col("y") == 0))
    return _items(spark, sf_dir).where("qtype = 'noul'").groupBy("qid").agg(F.count("*").alias("n"), d.alias("dangerous"), F.round(d / F.count("*"), 6).alias("rate"))


_THRESHOLDS = _SCORED + f""", g AS (SELECT qtype, l AS threshold, count_if(conf >= l) AS n, count_if(conf >= l AND err = 1) AS err
  FROM s, (VALUES {_LAMBDAS}) v(l) GROUP BY ALL)"""


@R.add("@g SELECT qtype, CAST(threshold AS DOUBLE) AS threshold, n, err FROM g", g=_THRESHOLDS)
def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and errors at or above every threshold."""
    return calibrate.threshold_table(_items(spark, sf_dir), ["qtype"])


_POLICY = _THRESHOLDS + f""", a AS (SELECT * FROM g, (VALUES (0.01), (0.02), (0.05)) v(alpha) WHERE n > 0),
t AS (SELECT qtype, alpha, n, err, threshold, CASE WHEN err >= n THEN 1 ELSE list_sum(list_transform(range(0, CAST(err AS BIGINT) + 1),
  lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(alpha) + (n - i) * ln(1 - alpha)))) END AS p FROM a),
p AS (SELECT qtype, CAST(alpha AS DOUBLE) AS alpha, CAST(min(CASE WHEN p <= {calibrate.DELTA} / {len(calibrate.LAMBDAS)} THEN threshold END) AS DOUBLE) AS threshold FROM t GROUP BY ALL)"""


@R.add("@p SELECT * FROM p", p=_POLICY)
def certified_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest threshold certified at each risk; null where none is."""
    return calibrate.certify(_items(spark, sf_dir), ["qtype"])


@R.add("@p SELECT alpha, CASE WHEN count(*) = count(threshold) THEN max(threshold) END AS threshold FROM p GROUP BY alpha", p=_POLICY)
def strictest_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.strictest(calibrate.certify(_items(spark, sf_dir), ["qtype"]), ["alpha"])


@R.add("""@p, x AS (SELECT s.qtype, p.alpha, coalesce(conf >= threshold, false) AS answered, err FROM s JOIN p USING (qtype))
SELECT qtype, alpha, round(avg(CAST(answered AS INT)), 6) AS coverage, round(sum(CASE WHEN answered THEN err END) / nullif(count_if(answered), 0), 6) AS risk FROM x GROUP BY ALL""", p=_POLICY)  # fmt: skip
def selective_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and risk under the certified thresholds."""
    s = _items(spark, sf_dir)
    out = calibrate.selective(calibrate.apply_policy(s, calibrate.certify(s, ["qtype"]), ["qtype"]), ["qtype", "alpha"])
    return out.select("qtype", "alpha", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@R.add(None)
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the accuracy from resampled groups (rows only: the draws are hashes)."""
    return metrics.bootstrap(_items(spark, sf_dir), ["qtype"], times=200)


@R.add("""@s, m AS (SELECT qid, pred, count(*) AS n FROM s GROUP BY ALL),
w AS (SELECT s.qid, avg(ok) AS acc_a, avg(CAST(y = b AS INT)) AS acc_b, avg(ok - CAST(y = b AS INT)) AS delta, count(*) AS n
  FROM s JOIN (SELECT qid, max_by(pred, (n, -pred)) AS b FROM m GROUP BY qid) USING (qid) GROUP BY s.qid)
SELECT qid, n, round(acc_a, 6) AS acc_a, round(acc_b, 6) AS acc_b, round(delta, 6) AS delta FROM w""", s=_SCORED)  # fmt: skip
def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictor against the most frequent prediction, on the same items."""
    s = _items(spark, sf_dir)
    most = s.groupBy("qid", "pred").agg(F.count("*").alias("n")).groupBy("qid").agg(F.max_by("pred", F.struct("n", (-F.col("pred")).alias("p"))).alias("b"))
    j = s.join(most, "qid").withColumn("ok_b", (F.col("y") == F.col("b")).cast("int"))
    return j.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("acc_a"), F.round(F.avg("ok_b"), 6).alias("acc_b"), F.round(F.avg(F.col("ok") - F.col("ok_b")), 6).alias("delta"))


@R.add("""@s, c AS (SELECT qid, y, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT qid, unnest(range(0, max(y) + 1)) AS y FROM c GROUP BY qid)
SELECT k.qid, CAST(k.y AS INT) AS y, round(ln((coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY k.qid)), 6) AS logit FROM k LEFT JOIN c ON k.qid = c.qid AND k.y = c.y""", s=_SCORED)  # fmt: skip
def majority_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of the prior of every option, one added to each count."""
    from ..operators.predictors import majority_prior as prior

    return prior(_items(spark, sf_dir)).select("qid", "y", F.round("logit", 6).alias("logit"))


_LAST = """WITH g AS (SELECT DISTINCT ON (item_id, a) * FROM (SELECT *, replace(lower(trim(regexp_replace(annotator, '[\\s_\\-]+', ' ', 'g'))), ' ', '_') AS a FROM gold) ORDER BY item_id, a, seq DESC),
v AS (SELECT item_id, a, ambiguity FROM g WHERE NOT skipped AND ambiguity BETWEEN 0 AND 3)"""


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.replace(F.lower(F.trim(F.regexp_replace("annotator", r"[\s_\-]+", " "))), F.lit(" "), F.lit("_"))
    g = table(spark, sf_dir, "gold").select("item_id", low.alias("a"), "seq", "skipped", "ambiguity")
    return latest(g, ["item_id", "a"], ["seq"], "not skipped and ambiguity between 0 and 3").select("item_id", "a", "ambiguity")


def _pairs(v: DataFrame) -> DataFrame:
    """Pairs of votes of different annotators on an item, by the pair; a handful an item, as many as it has annotators."""
    return v.select("item_id", F.col("a").alias("a1"), F.col("ambiguity").alias("x")).join(v.select("item_id", F.col("a").alias("a2"), F.col("ambiguity").alias("y")), "item_id").where("a1 < a2")


_KAPPA = _LAST + """, p AS (SELECT l.a AS a1, r.a AS a2, l.ambiguity AS x, r.ambiguity AS y FROM v l JOIN v r USING (item_id) WHERE l.a < r.a),
n AS (SELECT a1, a2, count(*) AS n, count_if(x = y) AS same FROM p GROUP BY ALL),
e AS (SELECT l.a1, l.a2, sum(@w * nx * ny) AS e FROM (SELECT a1, a2, x, count(*) AS nx FROM p GROUP BY ALL) l JOIN (SELECT a1, a2, y, count(*) AS ny FROM p GROUP BY ALL) r
  ON l.a1 = r.a1 AND l.a2 = r.a2 GROUP BY ALL),
o AS (SELECT a1, a2, sum(@w) AS o FROM p GROUP BY ALL)
SELECT a1, a2, n, round(same / n, 6) AS agreement, round(CASE WHEN e > 0 THEN 1 - o * n / e WHEN same = n THEN 1 ELSE 0 END, 6) AS kappa FROM n JOIN e USING (a1, a2) JOIN o USING (a1, a2)"""


@R.add(_KAPPA, w="CAST(x <> y AS DOUBLE)")
def annotator_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of every pair of annotators."""
    k = metrics.kappa(_pairs(_votes(spark, sf_dir)), ["a1", "a2"], "x", "y")
    return k.select("a1", "a2", "n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@R.add(_KAPPA, w="CAST((x - y) ** 2 AS DOUBLE)")
def annotator_kappa_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with squared distances as weights."""
    k = metrics.kappa(_pairs(_votes(spark, sf_dir)), ["a1", "a2"], "x", "y", quadratic=True)
    return k.select("a1", "a2", "n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@R.add("""WITH t AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
p AS (SELECT unnest([50, 95, 99]) AS percent)
SELECT event_type, CAST(percent AS INT) AS percent, value FROM t, p WHERE k = CAST(round_even(percent / 100 * (n - 1), 0) AS BIGINT) + 1""")  # fmt: skip
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by nearest rank."""
    return metrics.nearest_rank(table(spark, sf_dir, "events").where("value is not null"), ["event_type"], "value", [50, 95, 99])


@R.add("""@s, w AS (SELECT grp, count(*) AS pool FROM s WHERE grp IS NOT NULL GROUP BY grp)
SELECT qtype, round(sum(ok / pool) / sum(1 / pool), 6) AS weighted_accuracy FROM s JOIN w USING (grp) GROUP BY qtype""", s=_SCORED)  # fmt: skip
def weighted_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy in which every group weighs alike."""
    s = _items(spark, sf_dir).where("grp is not null")
    w = s.groupBy("grp").agg(F.count("*").alias("pool"))
    return s.join(w, "grp").groupBy("qtype").agg(F.round(F.sum(F.col("ok") / F.col("pool")) / F.sum(1 / F.col("pool")), 6).alias("weighted_accuracy"))


@R.add("""@s, d AS (SELECT member_id, rid, jurisdiction, part_name FROM dedup_member)
SELECT part_name, jurisdiction, count(*) AS n, round(avg(ok), 6) AS accuracy FROM s JOIN d USING (rid) GROUP BY ALL""", s=_SCORED)  # fmt: skip
def accuracy_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items joined with their requests."""
    d = table(spark, sf_dir, "dedup_member").select("rid", "jurisdiction", "part_name")
    return _items(spark, sf_dir).join(d, "rid").groupBy("part_name", "jurisdiction").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"))


@R.add("""WITH e AS (SELECT label, embedding FROM embeddings), c AS (SELECT label AS k, i, avg(v) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM e) GROUP BY ALL)
SELECT CAST(k AS INT) AS label, CAST(i AS INT) AS dim, round(m, 5) AS mean FROM c""")  # fmt: skip
def embedding_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of labelled embeddings, dimension by dimension."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return e.groupBy(F.col("label").cast("int").alias("label"), (F.col("i") + 1).cast("int").alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"))


@R.add(None)
def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature of logits made from the distances of embeddings to the centroids of labels (rows only)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), "embedding")
    long = e.select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    c = long.groupBy(F.col("label").alias("k"), "i").agg(F.avg("v").alias("m"))
    dist = long.join(c, "i").groupBy("vec_id", "label", "k").agg(F.sum(F.pow(F.col("v") - F.col("m"), F.lit(2.0))).alias("d"))
    logits = dist.groupBy("vec_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", (-F.col("d")).alias("z")))), lambda x: x.z).alias("logits"))
    return calibrate.fit_temperature(logits.withColumn("all", F.lit("all")), ["all"], "logits", "label").select(F.round("t", 3).alias("t"))
