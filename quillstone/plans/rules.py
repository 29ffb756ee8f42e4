"""Queries over rules and their texts, registers and privacy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import privacy
from ..operators import ontology
from ..session import table
from .registry import Registry

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql

_SIZES = """WITH g AS (SELECT DISTINCT seq, status, person_specific, alternatives AS alts FROM gold WHERE status IS NOT NULL AND alternatives IS NOT NULL AND NOT skipped),
s AS (SELECT *, list_transform(alts, lambda a: CASE WHEN a.collective IS NULL THEN list_sum(list_transform(a.roles, lambda r: r.n)) END) AS sizes,
  list_transform(alts, lambda a: CASE WHEN a.collective IS NULL THEN array_to_string(list_sort(list_transform(a.roles, lambda r: r.role || ':' || r.n)), ';') END) AS keys FROM g)"""


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "gold").where("status is not null and alternatives is not null and not skipped").select("seq", "status", "person_specific", "alternatives").distinct()


@R.add("""@s SELECT seq, CASE WHEN status = 'uninterpretable' OR len(alts) = 0 THEN NULL WHEN list_min(sizes) IS NULL THEN 'all_board' WHEN list_min(sizes) <= 1 THEN '1' WHEN list_min(sizes) = 2 THEN '2' ELSE '3+' END AS min_signers,
CASE WHEN status = 'uninterpretable' THEN NULL WHEN list_has_any(keys, ['CEO:1']) THEN true WHEN NOT coalesce(person_specific, false) THEN false END AS ceo_alone,
CASE WHEN status = 'uninterpretable' THEN NULL WHEN list_has_any(keys, ['CHAIR:1', 'BOARD_MEMBER:1']) THEN true WHEN NOT coalesce(person_specific, false) THEN false END AS chair_alone FROM s""", s=_SIZES)  # fmt: skip
def rule_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that follow from annotated alternatives."""
    a = ontology.answers(F.col("status"), F.col("alternatives"), F.col("person_specific"))
    return _gold(spark, sf_dir).select("seq", *[a[q].alias(q) for q in ("min_signers", "ceo_alone", "chair_alone")])


@R.add("""@s, o AS (SELECT seq, status, person_specific, list_filter(alts, lambda a: NOT list_contains(list_transform(coalesce(a.roles, []), lambda r: r.role), 'SIGNATORY')) AS alts FROM s),
z AS (SELECT *, list_transform(alts, lambda a: CASE WHEN a.collective IS NULL THEN list_sum(list_transform(a.roles, lambda r: r.n)) END) AS sizes FROM o),
f AS (SELECT *, alts[1].collective AS body, sizes[1] AS n, list_transform(alts[1].roles, lambda r: r.role) AS roles FROM z),
p AS (SELECT *, list_distinct(list_filter(roles, lambda r: r NOT IN ('BOARD_MEMBER', 'PARTNER', 'EXECUTIVE_MEMBER'))) AS part FROM f)
SELECT seq, CASE WHEN status = 'uninterpretable' THEN NULL WHEN len(alts) = 0 THEN CASE WHEN NOT coalesce(person_specific, false) THEN 'no_rule_registered' END
WHEN len(alts) >= 2 THEN CASE WHEN len(list_filter(sizes, lambda x: x = 1)) = len(sizes) THEN 'sole_specific_roles' WHEN list_contains(sizes, 1) THEN 'mixed_alternatives' ELSE 'joint_alternatives' END
WHEN body IS NOT NULL THEN 'board_jointly' WHEN part = ['PROKURIST'] AND len(list_distinct(roles)) = 1 THEN 'prokura_only_rule' WHEN n = 1 AND roles = ['CEO'] THEN 'sole_ceo' WHEN n = 1 AND roles = ['CHAIR'] THEN 'sole_chair'
WHEN n = 1 AND len(part) = 0 THEN 'sole_any_board_member' WHEN n = 1 THEN 'sole_specific_roles' WHEN n = 2 AND len(part) = 0 THEN 'joint_two_any' WHEN n = 2 AND len(part) = len(list_distinct(roles)) THEN 'joint_two_specific'
WHEN n = 2 OR len(part) > 0 THEN 'joint_role_combo' ELSE 'joint_three_plus' END AS derived_type FROM p""", s=_SIZES)  # fmt: skip
def rule_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern of each annotated rule."""
    return _gold(spark, sf_dir).select("seq", ontology.rule_type(F.col("status"), F.col("alternatives"), F.col("person_specific")).alias("derived_type"))


@R.add(None)
def coalition_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All answers of each annotated rule (rows only; tested against enumeration)."""
    a = ontology.answers(F.col("status"), F.col("alternatives"), F.col("person_specific"))
    return _gold(spark, sf_dir).select("seq", *[c.alias(q) for q, c in a.items()], ontology.minimal_coalitions(a).alias("minimal"))


@R.add(None)
def rule_truth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of every rule code (rows only)."""
    t = ontology.rule_table(spark)
    a = ontology.answers(F.lit("rule"), F.col("alternatives"), F.lit(False))
    return t.select("code", *[c.cast("string").alias(q) for q, c in a.items()])


@R.add(None)
def consistency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each annotated record's answers fit any rule (rows only)."""
    spelled = F.replace(F.lower(F.trim(F.regexp_replace("rule_type", r"[\s_\-]+", " "))), F.lit(" "), F.lit("_"))
    g = table(spark, sf_dir, "gold").where("not skipped").select("seq", spelled.alias("rule_type"), F.trim("min_signers").alias("min_signers"), "status", "alternatives", "person_specific").dropDuplicates(["seq"])
    a = {q: ontology.exact_answer(q, F.col("status"), F.col("alternatives"), F.col("person_specific")).cast("string") for q in ontology.EXACT}
    return ontology.consistent(g.select("seq", "rule_type", "min_signers", *[c.alias(q) for q, c in a.items()]), "seq")


@R.add(None)
def composed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signing texts all of whose parts are descriptions of rules (rows only; none where no text is so made up)."""
    t = table(spark, sf_dir, "dedup_member").where("signature_key is not null").select("member_id", F.col("signature_key").alias("t"))
    return ontology.compose(t, "member_id", "t")


@R.add("""WITH d AS (SELECT record_id, u.p AS p FROM no_record, unnest([signature_text, procuration_text]) u(p) WHERE u.p IS NOT NULL)
SELECT count(*) AS n_texts, count_if(regexp_matches(p, '[\\p{L}\\p{M}\\p{N}_.+-]+@[\\p{L}\\p{N}_-]+(\\.[\\p{L}\\p{N}_-]+)+')) AS n_with_mail FROM d""")
def mail_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with an e-mail address in its plain form."""
    d = table(spark, sf_dir, "no_record").select(F.explode(F.array("signature_text", "procuration_text")).alias("p")).where("p is not null")
    return d.agg(F.count("*").alias("n_texts"), F.count_if(F.col("p").rlike(privacy._EMAIL)).alias("n_with_mail"))


@R.add(None)
def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both texts of records with identity numbers, birth dates and e-mail addresses replaced, by built-in expressions only."""
    both = ("signature_text", "procuration_text")
    count = lambda c: F.coalesce(privacy.redactions(F.col(c)), F.lit(0))
    return table(spark, sf_dir, "no_record").select("record_id", *[privacy.redact(F.col(c)).alias(c) for c in both], F.when(F.coalesce(*both).isNotNull(), count(both[0]) + count(both[1])).alias("n"))


@R.add(None)
def masked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both texts of records with the listed names as numbered tokens, and whether a name seems to be left in either."""
    both = ("signature_text", "procuration_text")
    names = F.coalesce("person_names", F.array().cast("array<string>"))
    m = table(spark, sf_dir, "no_record").where(F.coalesce(*both).isNotNull()).select("record_id", *[privacy.mask_names(F.col(c), names).alias(c) for c in both])
    left = [privacy.residual_name(F.col(c), ["styret", "leder", "kr", "nok"]) for c in both]
    return m.withColumn("residual", left[0] | left[1])


@R.add("""SELECT kind, status_code, count(*) AS n, count(body) AS n_bodies, coalesce(count_if(CASE WHEN json_valid(body) THEN json_type(body) END = 'OBJECT'), 0) AS n_objects FROM (SELECT DISTINCT ON (lookup_id) * FROM fullmakt_signatur_rf) GROUP BY ALL""")
def lookup_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of lookups by kind and status, each delivered record once."""
    e = table(spark, sf_dir, "fullmakt_signatur_rf").select("lookup_id", "kind", "status_code", F.xxhash64("body").alias("h"), F.col("body").isNotNull().alias("b"), F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT").alias("o"))
    one = e.groupBy("lookup_id").agg(F.max(F.struct("h", "kind", "status_code", "b", "o")).alias("r")).select("r.*")
    return one.groupBy("kind", "status_code").agg(F.count("*").alias("n"), F.count_if("b").alias("n_bodies"), F.count_if("o").alias("n_objects"))


@R.add("""WITH s AS (SELECT DISTINCT ON (lookup_id) lookup_id, orgnr, kind FROM fullmakt_signatur_rf),
e AS (SELECT DISTINCT ON (orgnr) orgnr, orgform FROM no_entity ORDER BY orgnr, snapshot_date DESC, orgform DESC NULLS LAST)
SELECT coalesce(e.orgform, 'unknown') AS orgform, s.kind, count(*) AS n FROM s LEFT JOIN e USING (orgnr) GROUP BY ALL""")
def lookups_by_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups joined with the last snapshot of their entity."""
    s = table(spark, sf_dir, "fullmakt_signatur_rf").select("lookup_id", "orgnr", "kind").distinct()
    e = table(spark, sf_dir, "no_entity").groupBy("orgnr").agg(F.max_by("orgform", F.struct("snapshot_date", F.coalesce("orgform", F.lit("")))).alias("orgform"))
    return s.join(e, "orgnr", "left").groupBy(F.coalesce("orgform", F.lit("unknown")).alias("orgform"), "kind").agg(F.count("*").alias("n"))


@R.add("""SELECT CASE WHEN deleted IS NOT NULL AND deleted <> '' THEN 'deleted' WHEN orgform IN ('AS', 'ASA') THEN 'tier 1' WHEN orgform IN ('ANS', 'DA', 'KS', 'SA', 'SE', 'SPA', 'STI', 'IKS', 'SF', 'GFS', 'ESEK', 'PK', 'BA') THEN 'tier 2'
WHEN orgform IN ('BRL', 'BBL', 'FLI') THEN 'tier 3' WHEN orgform = 'ENK' THEN 'excluded' ELSE 'out of scope' END AS scope, count(*) AS n, count(DISTINCT orgnr) AS n_entities FROM no_entity GROUP BY 1""")
def entity_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by tier of their form, or by why they are left out."""
    from ..operators.registers import scope

    e = table(spark, sf_dir, "no_entity")
    return e.groupBy(scope(F.col("orgform"), F.col("deleted")).alias("scope")).agg(F.count("*").alias("n"), F.countDistinct("orgnr").alias("n_entities"))


@R.add("""SELECT path, count(*) AS n FROM (SELECT unnest(json_keys(body)) AS path FROM fullmakt_signatur_rf WHERE CASE WHEN json_valid(body) THEN json_type(body) END = 'OBJECT') GROUP BY path""")
def body_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of lookup bodies that are objects; values aren't looked at."""
    return table(spark, sf_dir, "fullmakt_signatur_rf").select(F.explode(F.json_object_keys("body")).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


@R.add(None)
def body_key_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All key paths of lookup bodies with their counts, at any depth (rows only)."""
    from ..sources.discover import key_paths

    return key_paths(table(spark, sf_dir, "fullmakt_signatur_rf"), "body")


@R.add(None)
def function_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that the codes of the functions in extracts decide (rows only)."""
    from ..operators.registers import extract_functions, coded_answers

    return coded_answers(extract_functions(table(spark, sf_dir, "at_extract")))
