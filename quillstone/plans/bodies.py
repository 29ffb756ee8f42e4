"""Queries over the rules that lookup bodies state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bodies, ontology
from ..session import table
from .registry import Registry

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


def _values(codes: dict[str, str]) -> str:
    return ", ".join(f"('{c}', '{v}')" for c, v in codes.items())


#: Readable bodies, unwrapped once or twice, and the codes of their combinations in order.
_BODIES = r"""WITH b AS (SELECT DISTINCT lookup_id, orgnr, kind, body FROM fullmakt_signatur_rf WHERE body IS NOT NULL AND json_valid(body)),
u AS (SELECT lookup_id, orgnr, kind, CASE WHEN json_type(body) = 'VARCHAR' THEN CASE WHEN json_valid(body ->> '$') THEN (body ->> '$')::JSON END ELSE body::JSON END AS j FROM b),
o AS (SELECT DISTINCT lookup_id, orgnr, kind, j ->> '$.status.rutineStatus.kode' AS routine, j ->> '$.status.regelStatus.kode' AS rule, j ->> '$.status.regelStatus.regelIdent' AS ident,
  nullif(trim(regexp_replace(j ->> '$.signeringsGrunnlag.signaturProkuraRoller.signaturProkuraFritekst', '\s+', ' ', 'g')), '') AS text, j -> '$.signeringsKombinasjon.kombinasjon' AS k
  FROM u WHERE json_type(j) = 'OBJECT'),
c AS (SELECT * EXCLUDE (k), list_filter(CASE json_type(k) WHEN 'ARRAY' THEN list_transform(from_json(k, '["JSON"]'), lambda x: x ->> '$.kode') WHEN 'OBJECT' THEN [k ->> '$.kode'] ELSE [] END, lambda x: x IS NOT NULL AND x <> '') AS codes FROM o),
"""
_SIGNING = f"""s AS (SELECT *, CASE WHEN rule = 'RF' THEN 'rule' WHEN rule = 'RT' THEN 'uninterpretable' WHEN text IS NOT NULL THEN 'uninterpretable' ELSE 'none' END AS status FROM c WHERE kind = 'signatur' AND routine = 'OK'),
a AS (SELECT *, CASE WHEN status = 'rule' AND coalesce(ident, '') <> '' THEN list_append(codes, ident) ELSE codes END AS every FROM s),
known AS (SELECT * FROM (VALUES {_values({c: 'rule' for c in ontology.RULES} | {c: 'statutory' for c in bodies.STATUTORY} | {c: 'person' for c in bodies.PERSONS} | {c: 'procuration' for c in bodies.PROCURATIONS})}) v(code, sort))
"""


@R.add(
    _BODIES + _SIGNING + """SELECT lookup_id, status, array_to_string(list_sort(coalesce((SELECT list(DISTINCT code) FROM unnest(every) t(code) JOIN known USING (code) WHERE sort = 'rule' AND status = 'rule'), [])), ';') AS rule_codes,
coalesce((SELECT bool_or(sort = 'person') FROM unnest(every) t(code) JOIN known USING (code)), false) AS person_specific,
(SELECT count(*) FROM unnest(every) t(code) WHERE code NOT IN (SELECT code FROM known)) AS n_unmapped FROM a"""
)
def lookup_signing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, rule codes and named signatories of each body on signing, and how many codes no table knows."""
    s = bodies.signing(bodies.lookup_codes(table(spark, sf_dir, "fullmakt_signatur_rf")))
    return s.select("lookup_id", "status", F.array_join(F.sort_array("rule_codes"), ";").alias("rule_codes"), "person_specific", F.size("unmapped").cast("bigint").alias("n_unmapped"))


_SIZES = ", ".join(
    f"('{c}', {min((sum(n for _, n in roles) if body is None else 99) for roles, body in map(ontology.parse_group, gs))})" for c, (_, gs) in ontology.RULES.items()
)


@R.add(
    _BODIES + _SIGNING + f""", z AS (SELECT * FROM (VALUES {_SIZES}) v(code, size)),
l AS (SELECT *, (SELECT min(size) FROM unnest(every) t(code) JOIN z USING (code) WHERE status = 'rule') AS by_rule, list_has_any(every, ['SIGN', 'SIHV']) AS alone, list_contains(every, 'SIFE') AS jointly,
  list_filter(every, lambda x: x IN ('STYR', 'DELT', 'INNH'))[1] AS default_code FROM a),
m AS (SELECT *, least(by_rule, CASE WHEN alone THEN 1 WHEN jointly THEN 2 END, CASE WHEN status = 'none' THEN CASE default_code WHEN 'STYR' THEN 99 WHEN 'DELT' THEN 1 WHEN 'INNH' THEN 1 END END) AS fewest FROM l)
SELECT lookup_id, CASE WHEN status = 'uninterpretable' OR fewest IS NULL THEN NULL WHEN fewest = 99 THEN 'all_board' WHEN fewest = 1 THEN '1' WHEN fewest = 2 THEN '2' ELSE '3+' END AS min_signers FROM m
WHERE NOT jointly OR alone"""
)
def lookup_min_signers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest signers by each body; bodies with joint named signatories alone are left to `lookup_answers`, as SQL doesn't count their persons."""
    codes = bodies.lookup_codes(table(spark, sf_dir, "fullmakt_signatur_rf"))
    has = lambda *cs: F.exists("codes", lambda x: x.getField("code").isin(*cs))
    s = bodies.signing(codes.where(~has("SIFE") & ~F.coalesce(F.col("ident") == "SIFE", F.lit(False)) | has("SIGN", "SIHV")))
    return s.select("lookup_id", ontology.min_signers(F.col("status"), F.col("alternatives"), F.col("statutory")).alias("min_signers"))


@R.add(None)
def lookup_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All answers and the level of ambiguity that follow from each body on signing (rows only; its parts are compared in SQL)."""
    s = bodies.signing(bodies.lookup_codes(table(spark, sf_dir, "fullmakt_signatur_rf")))
    a = ontology.answers(F.col("status"), F.col("alternatives"), F.col("person_specific"), F.col("statutory"))
    return s.select("lookup_id", *[c.cast("string").alias(q) for q, c in a.items()], bodies.ambiguity(s).alias("ambiguity"))


_SOLE = ", ".join(f"('{c}', '{'sole' if any(bodies._is_one(g) for g in gs) else 'joint'}')" for c, (_, gs) in ontology.RULES.items())


@R.add(
    _BODIES + f"""p AS (SELECT *, coalesce(routine = 'OK', false) AS ran, CASE WHEN rule = 'RF' AND coalesce(ident, '') <> '' THEN list_append(codes, ident) ELSE codes END AS every FROM c WHERE kind = 'prokura'),
r AS (SELECT * FROM (VALUES {_SOLE}) v(code, mode)), q AS (SELECT * FROM (VALUES {_values(bodies.PROCURATIONS)}) v(code, mode)),
m AS (SELECT *, coalesce((SELECT list(DISTINCT mode) FROM (SELECT q.mode FROM unnest(every) t(code) JOIN q USING (code)
  UNION ALL SELECT min(r.mode) FILTER (r.mode = 'sole') FROM unnest(every) t(code) JOIN r USING (code) WHERE rule = 'RF' HAVING count(*) FILTER (r.mode = 'sole') > 0
  UNION ALL SELECT 'joint' FROM unnest(every) t(code) JOIN r USING (code) WHERE rule = 'RF' HAVING count(*) > 0 AND count(*) FILTER (r.mode = 'sole') = 0) x), []) AS modes FROM p),
f AS (SELECT *, coalesce(rule IN ('RF', 'RT'), false) OR len(modes) > 0 OR text IS NOT NULL AS there FROM m)
SELECT lookup_id, CASE WHEN ran THEN there END AS present, CASE WHEN ran AND there THEN CASE len(modes) WHEN 0 THEN NULL WHEN 1 THEN modes[1] ELSE 'mixed' END END AS mode FROM f"""
)
def lookup_procuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether there is procuration by each body, and how it signs."""
    return bodies.procuration(bodies.lookup_codes(table(spark, sf_dir, "fullmakt_signatur_rf"))).select("lookup_id", "present", "mode")


@R.add(
    _BODIES + _SIGNING + """, n AS (SELECT *, (SELECT count(*) FROM unnest(every) t(code) WHERE code NOT IN (SELECT code FROM known)) > 0 AS un FROM a)
SELECT count(*) AS n_records, count_if(un) AS n_unmapped, round(count_if(un) / count(*), 6) AS share, count_if(un) / count(*) < 0.02 AS passed FROM n"""
)
def unmapped_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the bodies on signing with a code that no table knows, and whether it is below two per cent."""
    s = bodies.signing(bodies.lookup_codes(table(spark, sf_dir, "fullmakt_signatur_rf")))
    n = s.agg(F.count("*").alias("n_records"), F.count_if(F.size("unmapped") > 0).alias("n_unmapped"))
    share = F.try_divide("n_unmapped", "n_records")
    return n.select("n_records", "n_unmapped", F.round(share, 6).alias("share"), (share < 0.02).alias("passed"))


@R.add(
    _BODIES + _SIGNING + """SELECT code, count(*) AS n, count(DISTINCT lookup_id) AS n_lookups FROM (SELECT lookup_id, unnest(every) AS code FROM a) WHERE code NOT IN (SELECT code FROM known) GROUP BY code"""
)
def unmapped_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of bodies on signing that no table knows."""
    s = bodies.signing(bodies.lookup_codes(table(spark, sf_dir, "fullmakt_signatur_rf")))
    return s.select("lookup_id", F.explode("unmapped").alias("code")).groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("lookup_id").alias("n_lookups"))
