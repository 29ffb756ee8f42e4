"""Requests: their state, their questions, their checks, and decisions on answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Questions by type, and the options of those with choices (fixed values).
RULE_TYPES = [
    "sole_ceo", "sole_chair", "sole_any_board_member", "sole_specific_roles", "joint_two_any", "joint_two_specific", "joint_role_combo",
    "joint_three_plus", "board_jointly", "mixed_alternatives", "joint_alternatives", "prokura_only_rule", "no_rule_registered", "other_unmapped",
]
CHOICES = {"rule_type": RULE_TYPES, "min_signers": ["1", "2", "3+", "all_board"]}
LEVELS = {"ambiguity": 4}
#: Roles, by register, of which a company needs one for a question to apply (fixed values).
_AT_BOARD = ["Vorstandsmitglied", "Vorsitzender des Vorstands", "Obmann", "Obmann-Stellvertreter", "Stellvertreter des Vorsitzenden", "stellvertretendes Vorstandsmitglied"]
_AT = {"member": [*_AT_BOARD, "unbeschränkt haftender Gesellschafter"], "board": _AT_BOARD, "chair": ["Vorsitzender des Vorstands", "Obmann"], "deputy": ["Stellvertreter des Vorsitzenden", "Obmann-Stellvertreter"], "ceo": ["Geschäftsführer", "Geschäftsleiter"]}
_DK_BOARD = ["Bestyrelsesmedlem", "Formand", "Næstformand"]
_DK = {"member": [*_DK_BOARD, "Interessent", "Komplementar"], "board": _DK_BOARD, "chair": ["Formand"], "deputy": ["Næstformand"], "ceo": ["Direktør", "Administrerende direktør"]}
OFFICES = {"AT": _AT, "DK": _DK}
#: Offices that a question needs, all of them (fixed values).
NEEDS = {
    "member_alone": ["member"], "chair_with_member": ["member", "chair"], "three_members": ["member"], "two_board_members_jointly": ["board"],
    "ceo_with_one_board_member": ["board", "ceo"], "ceo_with_two_members": ["board", "ceo"], "chair_with_deputy": ["deputy"], "deputy_with_member": ["deputy"],
    "ceo_alone": ["ceo"], "two_ceos": ["ceo"], "ceo_with_chair": ["ceo", "chair"], "ceo_with_prokurist": ["ceo"], "chair_alone": ["chair"],
}
#: Codes of roles with their labels in display order (fixed values).
NO_ROLES = {
    "DAGL": "Daglig leder", "LEDE": "Styrets leder", "NEST": "Nestleder", "MEDL": "Styremedlem", "VARA": "Varamedlem", "DTPR": "Deltaker med proratarisk ansvar",
    "DTSO": "Deltaker med solidarisk ansvar", "KOMP": "Komplementar", "SIGN": "Signatur", "SIFE": "Signatur i fellesskap", "SIHV": "Signatur hver for seg", "PROK": "Prokura",
    "POFE": "Prokura i fellesskap", "POHV": "Prokura hver for seg", "INNH": "Innehaver",
}


def state(jurisdiction: Column, form: Column, signature: Column, procuration: Column, roles: Column) -> Column:
    """A request's state as JSON, keys in a fixed order; empty fields are left out."""
    full = lambda c: F.when(c != "", c)
    fields = F.struct(
        jurisdiction.alias("jurisdiction"), full(form).alias("legal_form"), full(signature).alias("signature_rule"), full(procuration).alias("procuration_rule"), F.when(F.size(roles) > 0, roles).alias("roles")
    )
    return F.to_json(fields)


def without(request: Column, keys: list[str], variant: str) -> Column:
    """A request without some keys of its state, marked as a variant."""
    s = request.getField("state")
    return request.withField("state", s.dropFields(*keys)).withField("meta", request.getField("meta").withField("variant", F.lit(variant)))


def label_errors(questions: Column) -> Column:
    """'question: what is wrong' of every label that its question doesn't allow; null labels are masked, not wrong."""

    def check(e: Column) -> Column:
        q, v = e.getField("key"), e.getField("value")
        label, kind = v.getField("label"), v.getField("type")
        options = F.create_map(*[x for k, o in CHOICES.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in o]))])
        known = F.coalesce(F.try_element_at(options, q), F.array().cast("array<string>"))
        wrong = (
            F.when(label.isNull(), F.lit(None).cast("string"))
            .when(kind == "noul", F.when(~label.isin("true", "false"), F.lit("no yes or no")))
            .when(kind == "score", F.when(~label.rlike(f"^[0-{LEVELS['ambiguity'] - 1}]$"), F.lit("no level")))
            .when(kind == "choice", F.when(~F.array_contains(known, label), F.lit("no option")))
            .otherwise("unknown type")
        )
        return F.when(wrong.isNotNull(), F.concat_ws(": ", q, wrong))

    return F.filter(F.transform(F.map_entries(questions), check), lambda x: x.isNotNull())


def applicable(questions: Column, jurisdiction: Column, roles: Column) -> Column:
    """Questions of a map without those about offices the company doesn't have; registers without a table of offices keep all."""
    names = F.transform(roles, lambda r: r.getField("role"))
    out = None
    for j, offices in OFFICES.items():
        has = {o: F.arrays_overlap(names, F.array(*[F.lit(x) for x in rs])) for o, rs in offices.items()}

        def fits(q: Column, has: dict[str, Column] = has) -> Column:
            ok = F.lit(True)
            for question, needs in NEEDS.items():
                met = F.lit(True)
                for n in needs:
                    met = met & F.coalesce(has[n], F.lit(False))
                ok = ok & ((q != question) | met)
            return ok

        kept = _filtered(questions, fits)
        out = F.when(jurisdiction == j, kept) if out is None else out.when(jurisdiction == j, kept)
    return out.otherwise(questions)


def _filtered(questions: Column, fits: object) -> Column:
    return F.map_filter(questions, lambda q, v: fits(q))


def render(lines: Column) -> Column:
    """'label [TOKEN]: text; …' of lines (ord, label, token, text) in order of ord; null if there are none."""
    said = F.transform(F.array_sort(lines), lambda x: F.concat(x.getField("label"), F.lit(" ["), x.getField("token"), F.lit("]: "), x.getField("text")))
    return F.when(F.size(lines) > 0, F.array_join(said, "; "))


def split_lines(text: Column) -> Column:
    """Lines of a rendered text as (label, text); a part without a colon has a null label."""

    def part(p: Column) -> Column:
        at = F.locate(": ", p)
        label = F.when(at > 0, F.regexp_replace(F.substring(p, F.lit(1), at - 1), r"\s*\[(?:PERSON|FIRMA)_\d+\]$", ""))
        return F.struct(label.alias("label"), F.when(at > 0, F.substring(p, at + 2, F.length(p))).otherwise(p).alias("text"))

    return F.transform(F.split(text, "; "), part)


def role_table(spark) -> DataFrame:
    """(code, label, ord) of NO_ROLES; a table of fixed size."""
    return spark.createDataFrame([(c, v, i) for i, (c, v) in enumerate(NO_ROLES.items())], "code string, label string, ord int")


def abstain(name_risk: Column, confidence: Column, threshold: Column, consistent: Column, experimental: Column) -> Column:
    """Why an answer is withheld, null if it is given: a name may be left in the text, then a missing or unmet threshold, then answers that contradict each other; an experimental question overrides them."""
    why = F.when(name_risk, "name risk").when(threshold.isNull() | (confidence < threshold), "threshold").when(~consistent, "inconsistent")
    return F.when(experimental, "experimental").otherwise(why)


def parity(a: DataFrame, b: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Agreement of two predictors' options by key: (n, n_unmatched, same_option, max_diff, mean_diff); keys that only one has are counted apart."""
    j = a.select(*keys, F.col(p).alias("_a"), F.col("pred").alias("_x")).join(b.select(*keys, F.col(p).alias("_b"), F.col("pred").alias("_y")), keys, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    d = F.when(both, F.abs(F.col("_a") - F.col("_b")))
    return j.agg(F.count_if(both).alias("n"), F.count_if(~both).alias("n_unmatched"), F.avg(F.when(both, (F.col("_x") == F.col("_y")).cast("int"))).alias("same_option"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"))


def drop_keys(df: DataFrame, wrong: set[str]) -> DataFrame:
    """`df` without the fields, at any depth of its schema, whose ascii key is in `wrong`; compiled from the schema once, no walk of values."""

    def ascii_(name: str) -> str:
        return "".join(c for c in name.lower().translate(str.maketrans("øåäöüõ", "oaaouo")).replace("æ", "ae") if c.isalnum())

    def clean(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            kept = [clean(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields if ascii_(f.name) not in wrong]
            return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: clean(x, t.elementType))
        if isinstance(t, T.MapType):
            return F.map_filter(F.transform_values(c, lambda k, v: clean(v, t.valueType)), lambda k, v: ~k.isin(*wrong)) if isinstance(t.keyType, T.StringType) else c
        return c

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if ascii_(f.name) not in wrong])


def map_strings(df: DataFrame, change: object) -> DataFrame:
    """`df` with every string at any depth of its schema changed by a function of columns."""

    def walk(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StringType):
            return change(c)
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields]))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: walk(x, t.elementType))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda k, v: walk(v, t.valueType))
        return c

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


#: Secrets by kind, as patterns (fixed values).
SECRETS = {
    "private key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "access key": "AKIA[0-9A-Z]{16}",
    "personal token": "gh[pousr]_[A-Za-z0-9]{30,}",
    "web token": "eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}",
    "assigned secret": "(?i)(password|passwd|secret|api[_-]?key)[ ]*[:=][ ]*[^ ]{6,}",
    "quoted secret": """(?i)(?:api[_-]?key|x-api-key|secret|password|passwd|token)["']?\\s*[:=]\\s*["'][^"'\\s]{12,}["']""",
    "fine-grained token": r"\bgithub_pat_[A-Za-z0-9_]{40,}",
    "model hub token": r"\bhf_[A-Za-z0-9]{30,}",
    "service key": r"\bsk-(?:ant-)?[A-Za-z0-9_-]{20,}",
    "birth date": r"""(?iu)["']?(?:f[oø]e?dsels(?:dato|nummer)|birth_?date|date_?of_?birth|geburtsdatum|s[uü]nniaeg|s[uü]nnikuup[aä]ev|isikukood|cpr(?:_?nummer)?)["']?\s*[:=]\s*["']?\d""",
}
#: A Danish personal number; its first six digits must be a day.
_CPR = r"(?<![0-9A-Za-z])(\d{6})-\d{4}(?![0-9A-Za-z])"
SECRET_KINDS = (*SECRETS, "CPR number")


def secret_lines(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, line, kind) of lines with a secret; the value is never given."""
    lines = df.where(F.col(text).isNotNull()).select(id, F.posexplode(F.split(F.col(text), "\n")).alias("line", "_l"))
    # The digits before the hyphen are day, month and year of the last century.
    day = lambda d: F.try_to_date(F.concat(F.lit("19"), F.substring(d, 5, 2), F.substring(d, 3, 2), F.substring(d, 1, 2)), "yyyyMMdd")
    cpr = F.exists(F.regexp_extract_all("_l", F.lit(_CPR), F.lit(1)), lambda d: day(d).isNotNull())
    kinds = F.filter(F.array(*[F.when(F.col("_l").rlike(p), k) for k, p in SECRETS.items()], F.when(cpr, "CPR number")), lambda k: k.isNotNull())
    return lines.select(id, "line", F.explode(kinds).alias("kind"))


def scrub(text: Column, allowed: list[str]) -> Column:
    """The redacted text with every capitalised word that isn't `allowed` (in lower case) as [X]; tokens in brackets stay. Null stays null."""
    from ..functions.privacy import redact

    parts = F.regexp_extract_all(redact(text), F.lit(r"(\[[A-Z]+(?:_\d+)?\]|\p{L}[\p{L}\p{M}'-]*|[^\p{L}\[]+|\[)"), F.lit(1))
    kept = F.array(*[F.lit(w) for w in allowed])
    return F.array_join(F.transform(parts, lambda w: F.when(w.rlike(r"^\p{Lu}") & ~F.array_contains(kept, F.lower(w)), F.lit("[X]")).otherwise(w)), "")
