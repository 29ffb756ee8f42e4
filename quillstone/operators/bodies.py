"""What lookup bodies say: the signing rule, the procuration, and codes that no table knows.

A body is read once by the automaton of `structure`, into one narrow row, its text also composed and folded; everything after
that is built-in column expressions over its array of codes, without a shuffle and without Python, before which Spark would
queue whole rows with their groups on disk. Codes are looked up in literal maps of fixed size.

Defined cases: a body that can't be read gives no row; a missing routine, status, text or list is null or empty; a lone
object in the place of a list is a list of one; a lookup delivered twice with one content counts once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, folded_key, spaced
from . import ontology
from . import structure as S

#: What the register's status says of the signing rule; any other is none (fixed values).
STATUS = {"RF": "rule", "RT": "uninterpretable", "RI": "none"}
#: Codes of statutory rules, with their groups (fixed values).
STATUTORY = {"STYR": ["*ALL_BOARD"], "DELT": ["PARTNER:1"], "INNH": ["OTHER:1"]}
#: Codes of named signatories and of procuration, with how they sign (fixed values).
PERSONS = {"SIGN": "sole", "SIHV": "sole", "SIFE": "joint"}
PROCURATIONS = {"PROK": "sole", "POHV": "sole", "POFE": "joint"}

#: Places of a body that bear on its rule.
RULE_SHAPES = {
    "body": S.Shape(steps={"status": "status", "signeringsGrunnlag": "basis", "signeringsKombinasjon": "combinations"}),
    "status": S.Shape(steps={"rutineStatus": "routine", "regelStatus": "rule"}),
    "routine": S.Shape(child="routine", code=("kode",)),
    "rule": S.Shape(child="rule", code=("kode",)),
    "basis": S.Shape(steps={"signaturProkuraRoller": "roles"}),
    "roles": S.Shape(child="text", code=("signaturProkuraFritekst",)),
    "combinations": S.Shape(steps={"kombinasjon": "combination"}),
    "combination": S.Shape(repeated=True, child="combination", code=("kode",)),
}
_CODES = "array<struct<code:string,n:int>>"
_ROW = pa.schema(
    [("lookup_id", pa.int64()), ("orgnr", pa.string()), ("kind", pa.string()), ("routine", pa.string()), ("rule", pa.string()), ("ident", pa.string())]
    + [("text", pa.string()), ("composed", pa.string()), ("folded", pa.string())]
    + [("codes", pa.list_(pa.struct([("code", pa.string()), ("n", pa.int32())])))]
)


def _read(node: dict, path: tuple[str, ...]) -> tuple[str | None, str | None, int]:
    """The code of a node, the identity of its rule, and its number of persons."""
    people = S.unwrap(node.get("personRolleKombinasjon"))
    n = len(people) if isinstance(people, list) else int(isinstance(people, dict))
    return S._scalar(node.get(path[-1])), S._scalar(node.get("regelIdent")), n


def _written(text: str | None) -> tuple[str | None, str | None, str | None]:
    """A text as it is, composed, and folded."""
    return (None, None, None) if text is None else (text, unicodedata.normalize("NFC", text), fold(text))


def lookup_codes(lookups: DataFrame) -> DataFrame:
    """(lookup_id, orgnr, kind, routine, rule, ident, text, composed, folded, codes) of each readable body; codes are (code, n persons) in order."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lookup, orgnr, kind, body in zip(*(c.to_pylist() for c in batch.columns)):
                root = S.unwrap(S.read_json(body))
                if not isinstance(root, dict):
                    continue
                one: dict[str, str | None] = {}
                codes = []
                for child, at, (code, ident, n), _ in S.run_automaton(RULE_SHAPES, "body", root, _read):
                    if child == "combination":
                        codes.append((at, code, n))
                    else:
                        one[child] = code
                        if child == "rule":
                            one["ident"] = ident
                codes = [{"code": c, "n": n} for _, c, n in sorted(codes, key=lambda x: x[0]) if c]
                rows.append((lookup, orgnr, kind, one.get("routine"), one.get("rule"), one.get("ident"), *_written(one.get("text")), codes))
            cols = list(zip(*rows)) if rows else [()] * len(_ROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROW)], schema=_ROW)

    slim = lookups.select(F.col("lookup_id").cast("bigint").alias("lookup_id"), "orgnr", "kind", "body").where("lookup_id is not null and body is not null")
    return slim.mapInArrow(scan, f"lookup_id bigint, orgnr string, kind string, routine string, rule string, ident string, text string, composed string, folded string, codes {_CODES}").distinct()


def _group(text: str) -> Column:
    roles, body = ontology.parse_group(text)
    parts = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(n).alias("n")) for r, n in roles]) if roles else F.array()
    return F.struct(parts.cast("array<struct<role:string,n:int>>").alias("roles"), F.lit(body).cast("string").alias("collective"))


def _groups_of(codes: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for c, gs in codes.items() for x in (F.lit(c), F.array(*[_group(g) for g in gs]))])


def _modes_of(codes: dict[str, str]) -> Column:
    return F.create_map(*[x for c, m in codes.items() for x in (F.lit(c), F.lit(m))])


def _plain(composed: Column) -> Column:
    return F.nullif(spaced(composed), F.lit(""))


def _with_ident(codes: Column, ident: Column, counts: Column) -> Column:
    """The codes, and the identity of the rule as one more where it counts."""
    more = F.array(F.struct(ident.alias("code"), F.lit(0).alias("n"))).cast(_CODES)
    return F.when(counts & (F.coalesce(ident, F.lit("")) != ""), F.concat(codes, more)).otherwise(codes)


def _known(code: Column) -> Column:
    return code.isin(*ontology.RULES, *STATUTORY, *PERSONS, *PROCURATIONS)


def signing(codes: DataFrame) -> DataFrame:
    """(lookup_id, orgnr, status, text, folded, rule_codes, alternatives, statutory, person_specific, unmapped) of the bodies on
    signing whose routine ran: groups of all rules under a rule status, a SIGNATORY group for named persons."""
    rules, statutory, persons = _groups_of({c: gs for c, (_, gs) in ontology.RULES.items()}), _groups_of(STATUTORY), _modes_of(PERSONS)
    text = _plain(F.col("composed"))
    said = F.coalesce(*[F.when(F.col("rule") == k, v) for k, v in STATUS.items()], F.lit("none"))
    rows = codes.where("kind = 'signatur' and routine = 'OK'").withColumn("status", F.when((said == "none") & text.isNotNull(), "uninterpretable").otherwise(said))
    rows = rows.withColumn("all", _with_ident(F.col("codes"), F.col("ident"), F.col("status") == "rule"))
    code = F.transform("all", lambda x: x.getField("code"))
    of_rules = F.when(F.col("status") == "rule", F.array_distinct(F.filter(code, lambda c: c.isin(*ontology.RULES)))).otherwise(F.array().cast("array<string>"))
    named = F.filter("all", lambda x: x.getField("code").isin(*PERSONS))

    def signatory(x: Column) -> Column:
        n = F.when(F.try_element_at(persons, x.getField("code")) == "joint", F.greatest(x.getField("n"), F.lit(2))).otherwise(1)
        role = F.struct(F.lit("SIGNATORY").alias("role"), n.alias("n"))
        return F.struct(F.array(role).alias("roles"), F.lit(None).cast("string").alias("collective"))

    groups = F.concat(F.flatten(F.transform("rule_codes", lambda c: F.try_element_at(rules, c))), F.transform(named, signatory))
    rows = rows.select("lookup_id", "orgnr", "status", text.alias("text"), "folded", of_rules.alias("rule_codes"), "all", code.alias("code"))
    return rows.select(
        "lookup_id", "orgnr", "status", "text", "folded", "rule_codes", F.array_distinct(groups.cast(f"array<{ontology.GROUP}>")).alias("alternatives"),
        F.get(F.try_element_at(statutory, F.get(F.filter("code", lambda c: c.isin(*STATUTORY)), F.lit(0))), F.lit(0)).cast(ontology.GROUP).alias("statutory"),
        (F.size(named) > 0).alias("person_specific"), F.filter("code", lambda c: ~_known(c)).alias("unmapped"),
    )


def ambiguity(rows: DataFrame) -> Column:
    """0 where the text is the description of the single rule, 1 where an interpreted rule has other wording; null without rule or text."""
    described = F.create_map(*[x for c, (d, _) in ontology.RULES.items() for x in (F.lit(c), F.lit(fold(d)))])
    same = (F.size("rule_codes") == 1) & (folded_key(F.col("folded")) == folded_key(F.try_element_at(described, F.get("rule_codes", F.lit(0)))))
    return F.when((F.col("status") == "rule") & F.col("text").isNotNull() & (F.size("rule_codes") > 0), F.when(same, 0).otherwise(1))


def procuration(codes: DataFrame) -> DataFrame:
    """(lookup_id, orgnr, present, mode, unmapped) of the bodies on procuration: sole, joint or mixed; both null where the routine didn't run."""
    modes, rules = _modes_of(PROCURATIONS), F.create_map(*[x for c, (_, gs) in ontology.RULES.items() for x in (F.lit(c), F.lit(any(_is_one(g) for g in gs)))])
    rows = codes.where("kind = 'prokura'").withColumn("ran", F.coalesce(F.col("routine") == "OK", F.lit(False)))
    rows = rows.withColumn("code", F.transform(_with_ident(F.col("codes"), F.col("ident"), F.coalesce(F.col("rule") == "RF", F.lit(False))), lambda x: x.getField("code")))
    under = F.when(F.col("rule") == "RF", F.filter("code", lambda c: c.isin(*ontology.RULES))).otherwise(F.array().cast("array<string>"))
    by_rule = F.when(F.size(under) > 0, F.when(F.exists(under, lambda c: F.try_element_at(rules, c)), "sole").otherwise("joint"))
    all_ = F.array_distinct(F.filter(F.concat(F.transform("code", lambda c: F.try_element_at(modes, c)), F.array(by_rule)), lambda m: m.isNotNull()))
    present = F.coalesce(F.col("rule").isin("RF", "RT"), F.lit(False)) | (F.size("modes") > 0) | _plain(F.col("composed")).isNotNull()
    mode = F.when(F.size("modes") > 1, "mixed").when(F.size("modes") == 1, F.get("modes", F.lit(0)))
    return rows.withColumn("modes", all_).select(
        "lookup_id", "orgnr", F.when(F.col("ran"), present).alias("present"), F.when(F.col("ran") & present, mode).alias("mode"),
        F.when(F.col("ran"), F.filter("code", lambda c: ~_known(c))).otherwise(F.array().cast("array<string>")).alias("unmapped"),
    )


def _is_one(group: str) -> bool:
    roles, body = ontology.parse_group(group)
    return body is None and sum(n for _, n in roles) == 1
