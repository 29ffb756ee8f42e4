"""Queries over requests: state, validity, applicability, roles, decisions, secrets, phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import privacy
from ..operators import calibrate, metrics, ontology, phrases, registers, requests
from ..operators import structure as S
from ..session import table
from .evaluation import _POLICY, _SCORED
from .registry import Registry

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql

_Q = "(SELECT member_id, jurisdiction, request.state.roles AS roles, u.q.key AS qid, u.q.value.type AS kind, u.q.value.label AS label FROM dedup_member m, unnest(map_entries(request.questions)) u(q))"
_TYPES = ", ".join(f"'{t}'" for t in requests.RULE_TYPES)


@R.add(f"""WITH e AS (SELECT qid, CASE WHEN label IS NULL THEN NULL WHEN kind = 'noul' THEN CASE WHEN label NOT IN ('true', 'false') THEN 'no yes or no' END
WHEN kind = 'score' THEN CASE WHEN NOT regexp_matches(label, '^[0-3]$') THEN 'no level' END
WHEN kind = 'choice' THEN CASE WHEN NOT ((qid = 'rule_type' AND label IN ({_TYPES})) OR (qid = 'min_signers' AND label IN ('1', '2', '3+', 'all_board'))) THEN 'no option' END ELSE 'unknown type' END AS wrong FROM {_Q})
SELECT coalesce(qid || ': ' || wrong, 'fine') AS error, count(*) AS n FROM e GROUP BY 1""")
def label_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that their question doesn't allow."""
    d = table(spark, sf_dir, "dedup_member").select(F.size("request.questions").alias("k"), requests.label_errors(F.col("request.questions")).alias("e"))
    wrong = d.select(F.explode("e").alias("error")).groupBy("error").agg(F.count("*").alias("n"))
    fine = d.agg((F.sum("k") - F.sum(F.size("e"))).alias("n")).where("n > 0").select(F.lit("fine").alias("error"), "n")
    return wrong.unionAll(fine)


def _office_sql() -> str:
    def needs(j: str) -> str:
        cases = []
        for q, offices in requests.NEEDS.items():
            met = " AND ".join("list_has_any(names, [" + ", ".join(f"'{r}'" for r in requests.OFFICES[j][o]) + "])" for o in offices)
            cases.append(f"WHEN qid = '{q}' THEN {met}")
        return f"WHEN jurisdiction = '{j}' THEN CASE {' '.join(cases)} ELSE true END"

    return f"CASE {needs('AT')} {needs('DK')} ELSE true END"


@R.add(f"""WITH q AS (SELECT *, list_transform(roles, lambda r: r.role) AS names FROM {_Q}), k AS (SELECT jurisdiction, qid, {_office_sql()} AS kept FROM q)
SELECT jurisdiction, qid, count(*) AS n, count_if(kept) AS n_kept FROM k GROUP BY ALL HAVING count_if(kept) > 0""")
def applicable_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that are left once those about offices that a company doesn't have are dropped."""
    m = table(spark, sf_dir, "dedup_member").select("jurisdiction", F.col("request.questions").alias("q"), F.col("request.state.roles").alias("roles"))
    m = m.withColumn("kept", requests.applicable(F.col("q"), F.col("jurisdiction"), F.col("roles")))
    long = m.select("jurisdiction", "kept", F.explode("q").alias("qid", "v"))
    return long.groupBy("jurisdiction", "qid").agg(F.count("*").alias("n"), F.count_if(F.map_contains_key("kept", F.col("qid"))).alias("n_kept")).where("n_kept > 0")


@R.add("""SELECT member_id, request.state.jurisdiction AS jurisdiction, nullif(request.state.legal_form, '') AS legal_form, nullif(request.state.signature_rule, '') AS signature_rule,
nullif(request.state.procuration_rule, '') AS procuration_rule, nullif(len(request.state.roles), 0) AS n_roles FROM dedup_member""")
def state_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States as JSON, with what their fields hold when they are read back."""
    s = F.col("request.state")
    j = requests.state(s.getField("jurisdiction"), s.getField("legal_form"), s.getField("signature_rule"), s.getField("procuration_rule"), s.getField("roles"))
    d = table(spark, sf_dir, "dedup_member").select("member_id", j.alias("j"))
    fields = ["jurisdiction", "legal_form", "signature_rule", "procuration_rule"]
    return d.select("member_id", *[F.get_json_object("j", f"$.{f}").alias(f) for f in fields], F.json_array_length(F.get_json_object("j", "$.roles")).cast("bigint").alias("n_roles"))


_ROLE_VALUES = ", ".join(f"('{c}', '{v}', {i})" for i, (c, v) in enumerate(requests.NO_ROLES.items()))


@R.add(f"""WITH r AS (SELECT u.e.key AS code, u.e.value AS n FROM no_record, unnest(map_entries(role_counts)) u(e)), d AS (SELECT * FROM (VALUES {_ROLE_VALUES}) v(code, label, ord))
SELECT coalesce(label, r.code) AS label, coalesce(ord, 99) AS ord, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n_holders FROM r LEFT JOIN d ON r.code = d.code GROUP BY ALL""")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holders by role, with the label of the code or the code itself."""
    r = table(spark, sf_dir, "no_record").select(F.explode("role_counts").alias("code", "n"))
    j = r.join(F.broadcast(requests.role_table(spark)), "code", "left")
    return j.groupBy(F.coalesce("label", "code").alias("label"), F.coalesce("ord", F.lit(99)).alias("ord")).agg(F.count("*").alias("n_records"), F.sum("n").alias("n_holders"))


def _gates(items: DataFrame, members: DataFrame) -> DataFrame:
    """(rid, name_risk, consistent): whether a name may be left in a request's texts, and whether some rule gives all its structural answers;
    rules with a named signatory count only where its roles show one."""
    state = F.col("request.state")
    risk = lambda t: F.coalesce(*[F.when(F.col("jurisdiction") == k, privacy.residual_name(t, ws)) for k, ws in privacy.LEGAL_WORDS.items()], privacy.residual_name(t, privacy.LEGAL_WORDS["NO"]))
    named = F.coalesce(F.exists(state.getField("roles"), lambda r: F.lower(r.getField("role")).contains("signatur")), F.lit(False))
    m = members.select("rid", (risk(state.getField("signature_rule")) | risk(state.getField("procuration_rule"))).alias("name_risk"), named.alias("named"))
    option = F.coalesce(*[F.when(F.col("qid") == q, F.get(F.array(*[F.lit(o) for o in os]), F.col("pred"))) for q, os in requests.CHOICES.items()], F.when(F.col("qtype") == "noul", (F.col("pred") == 1).cast("string")))
    said = items.where("pred is not null and conf is not null").groupBy("rid").agg(*[F.max(F.when(F.col("qid") == q, option)).alias(q) for q in ontology.STRUCTURAL]).join(m, "rid")
    fits = ontology.consistent(said.where("named"), "rid").unionAll(ontology.consistent(said.where("not named"), "rid", named=False))
    return m.select("rid", "name_risk").join(fits, "rid", "left")


@R.add("""@p, x AS (SELECT CASE WHEN qid = 'parseable' THEN 'experimental' WHEN p.threshold IS NULL OR conf < p.threshold THEN 'threshold' ELSE 'answered' END AS reason, s.qtype FROM s JOIN p USING (qtype) WHERE p.alpha = 0.05)
SELECT qtype, reason, count(*) AS n FROM x GROUP BY ALL""", p=_POLICY)  # fmt: skip
def threshold_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why answers are withheld at a risk of five per cent, by their thresholds alone."""
    s = metrics.scored(table(spark, sf_dir, "item"))
    policy = calibrate.certify(s, ["qtype"], [0.05]).select("qtype", "threshold")
    why = requests.abstain(F.lit(False), F.col("conf"), F.col("threshold"), F.lit(True), F.col("qid") == "parseable")
    return s.join(policy, "qtype").groupBy("qtype", F.coalesce(why, F.lit("answered")).alias("reason")).agg(F.count("*").alias("n"))


@R.add(None)
def decision_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why answers are withheld at a risk of five per cent, names left in texts and contradicting answers included (rows only)."""
    items, members = table(spark, sf_dir, "item"), table(spark, sf_dir, "dedup_member")
    s = metrics.scored(items)
    policy = calibrate.certify(s, ["qtype"], [0.05]).select("qtype", "threshold")
    j = s.join(policy, "qtype").join(_gates(items, members), "rid", "left")
    fits = F.coalesce("consistent", F.lit(True)) | ~F.col("qid").isin(*ontology.STRUCTURAL)
    why = requests.abstain(F.coalesce("name_risk", F.lit(False)), F.col("conf"), F.col("threshold"), fits, F.col("qid") == "parseable")
    return j.groupBy("qtype", F.coalesce(why, F.lit("answered")).alias("reason")).agg(F.count("*").alias("n"))


@R.add("""@s, d AS (SELECT rid, qid, min(conf) AS p, min(pred) AS pred FROM s GROUP BY ALL), b AS (SELECT rid, qid, min(p_gold) AS p, min(y) AS pred FROM s WHERE p_gold IS NOT NULL GROUP BY ALL)
SELECT count(b.p) AS n, count(*) - count(b.p) AS n_unmatched, round(avg(CASE WHEN b.p IS NOT NULL THEN CAST(d.pred = b.pred AS INT) END), 6) AS same_option, round(max(abs(d.p - b.p)), 6) AS max_diff, round(avg(abs(d.p - b.p)), 6) AS mean_diff
FROM d LEFT JOIN b ON d.rid = b.rid AND d.qid = b.qid""", s=_SCORED)  # fmt: skip
def model_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions with their confidences against the right options with theirs, where there are any."""
    s = metrics.scored(table(spark, sf_dir, "item"))
    d = s.groupBy("rid", "qid").agg(F.min("conf").alias("p"), F.min("pred").alias("pred"))
    b = s.where("p_gold is not null").groupBy("rid", "qid").agg(F.min("p_gold").alias("p"), F.min("y").alias("pred"))
    out = requests.parity(d, b, ["rid", "qid"])
    return out.select("n", "n_unmatched", *[F.round(c, 6).alias(c) for c in ("same_option", "max_diff", "mean_diff")])


@R.add(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT list_filter(regexp_extract_all(l, '(^|[^0-9A-Za-z])([0-9]{6})-[0-9]{4}($|[^0-9A-Za-z])', 2), lambda d: try_strptime('19' || d[5:6] || d[3:4] || d[1:2], '%Y%m%d') IS NOT NULL) AS days FROM l)
SELECT 'private key' AS kind, count_if(regexp_matches(l, '-----BEGIN [A-Z ]*PRIVATE KEY-----')) AS n FROM l
UNION ALL SELECT 'access key', count_if(regexp_matches(l, 'AKIA[0-9A-Z]{16}')) FROM l
UNION ALL SELECT 'personal token', count_if(regexp_matches(l, 'gh[pousr]_[A-Za-z0-9]{30,}')) FROM l
UNION ALL SELECT 'web token', count_if(regexp_matches(l, 'eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}')) FROM l
UNION ALL SELECT 'assigned secret', count_if(regexp_matches(l, '(?i)(password|passwd|secret|api[_-]?key)[ ]*[:=][ ]*[^ ]{6,}')) FROM l
UNION ALL SELECT 'quoted secret', count_if(regexp_matches(l, '(?i)(api[_-]?key|x-api-key|secret|password|passwd|token)["'']?[ \t]*[:=][ \t]*["''][^"'' \t]{12,}["'']')) FROM l
UNION ALL SELECT 'fine-grained token', count_if(regexp_matches(l, '(^|[^A-Za-z0-9_])github_pat_[A-Za-z0-9_]{40,}')) FROM l
UNION ALL SELECT 'model hub token', count_if(regexp_matches(l, '(^|[^A-Za-z0-9_])hf_[A-Za-z0-9]{30,}')) FROM l
UNION ALL SELECT 'service key', count_if(regexp_matches(l, '(^|[^A-Za-z0-9_])sk-(ant-)?[A-Za-z0-9_-]{20,}')) FROM l
UNION ALL SELECT 'birth date', count_if(regexp_matches(l, '(?i)["'']?(f(o|ø|e|oe|øe)?dsels(dato|nummer)|birth_?date|date_?of_?birth|geburtsdatum|s[uü]nniaeg|s[uü]nnikuup[aä]ev|isikukood|cpr(_?nummer)?)["'']?[ \t]*[:=][ \t]*["'']?[0-9]')) FROM l
UNION ALL SELECT 'CPR number', count_if(len(days) > 0) FROM c""")  # fmt: skip
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with secrets, by kind; the values are never given."""
    found = requests.secret_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").groupBy("kind").agg(F.count("*").alias("n"))
    kinds = spark.createDataFrame([(k,) for k in requests.SECRET_KINDS], "kind string")
    return kinds.join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@R.add(None)
def redacted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with every string, at any depth, redacted, and without keys of personal identifiers; compiled from the schema (rows only)."""
    d = table(spark, sf_dir, "dedup_member").select("member_id", "request")
    return requests.map_strings(requests.drop_keys(d, set(privacy.PERSONAL_KEYS)), privacy.redact)


@R.add(None)
def representation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from the wording and the codes of extracts (rows only). Without any wording, E alone and X are clear by themselves; a company with another line that lacks one is left out."""
    f = registers.extract_functions(table(spark, sf_dir, "at_extract")).where(F.col("fken").isin(*registers.REPRESENTING))
    office = F.when(F.col("fken").isin("GF", "GL"), "CEO").when((F.col("fken") == "VM") & F.col("vsbeide").isin("V", "O"), "CHAIR").when((F.col("fken") == "VM") & F.col("vsbeide").isin("B", "R"), "DEPUTY_CHAIR").when(F.col("fken") == "VM", "BOARD_MEMBER").otherwise("PARTNER")
    return phrases.company_rules(f.select(F.col("extract_id").alias("company"), office.alias("office"), F.col("wording").alias("text"), F.col("vart").alias("code")))


@R.add(None)
def wording_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the representation texts of extracts say (rows only)."""
    t = S.extract_nodes(table(spark, sf_dir, "at_extract"))
    return t.groupBy(F.coalesce(phrases.read_line(F.col("code")).getField("kind"), F.lit("not in the table")).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("n_extracts"))


@R.add(None)
def holders_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct persons by role and lookup, from the three places where bodies name people (rows only)."""
    p = S.holders(table(spark, sf_dir, "fullmakt_signatur_rf"))
    return p.groupBy("role").agg(F.countDistinct("orgnr", "name").alias("n_holders"), F.countDistinct("orgnr").alias("n_companies"))
