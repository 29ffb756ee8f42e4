"""Rules as alternatives of groups, and the answers that follow from them.

A rule is (status, alternatives, person_specific, statutory): alternatives is an array of groups, each
with `roles`, an array of (role, n), and `collective`. All answers are column expressions over that array; an answer that the
rule leaves open is null.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

GROUP = "struct<roles:array<struct<role:string,n:int>>,collective:string>"
#: Roles that stand for any member of a body (fixed values).
MEMBERS = ("BOARD_MEMBER", "PARTNER", "EXECUTIVE_MEMBER")
#: Seats that each person of a coalition can take (fixed values).
SEATS = {
    "CEO": ("CEO",),
    "CHAIR": ("CHAIR", "BOARD_MEMBER", "EXECUTIVE_MEMBER"),
    "DEPUTY": ("DEPUTY_CHAIR", "BOARD_MEMBER", "EXECUTIVE_MEMBER"),
    "PROKURIST": ("PROKURIST",),
    "MEMBER": ("BOARD_MEMBER", "PARTNER", "EXECUTIVE_MEMBER"),
}
#: Persons of each coalition question (fixed values).
COALITIONS = {
    "member_alone": ("MEMBER",), "two_ceos": ("CEO", "CEO"), "ceo_with_chair": ("CEO", "CHAIR"), "ceo_with_prokurist": ("CEO", "PROKURIST"),
    "chair_with_member": ("CHAIR", "MEMBER"), "three_members": ("MEMBER", "MEMBER", "MEMBER"), "prokurist_alone": ("PROKURIST",), "two_prokurists": ("PROKURIST", "PROKURIST"),
    "chair_with_deputy": ("CHAIR", "DEPUTY"), "deputy_with_member": ("DEPUTY", "MEMBER"), "ceo_with_two_members": ("CEO", "MEMBER", "MEMBER"),
}
OLDER = {"ceo_alone": ("CEO",), "chair_alone": ("CHAIR",), "two_board_members_jointly": ("MEMBER", "MEMBER"), "ceo_with_one_board_member": ("CEO", "MEMBER")}
#: Groups that answer the older questions when they stand in a rule exactly so (fixed values).
EXACT = {
    "ceo_alone": ["CEO:1"],
    "chair_alone": ["CHAIR:1", "BOARD_MEMBER:1"],
    "two_board_members_jointly": ["BOARD_MEMBER:1", "BOARD_MEMBER:2"],
    "ceo_with_one_board_member": ["CEO:1", "BOARD_MEMBER:1", "BOARD_MEMBER:1;CEO:1"],
}
#: Codes of rules: description and groups; '*' marks a whole body (fixed values).
RULES = {
    "R0001": ("Styrets leder alene", ["CHAIR:1"]),
    "R0002": ("Daglig leder alene", ["CEO:1"]),
    "R0003": ("Styret i fellesskap", ["*ALL_BOARD"]),
    "R0004": ("Styrets leder og ett styremedlem i fellesskap", ["CHAIR:1;BOARD_MEMBER:1"]),
    "R0005": ("To styremedlemmer i fellesskap", ["BOARD_MEMBER:2"]),
    "R0006": ("Styrets medlemmer hver for seg", ["BOARD_MEMBER:1"]),
    "R0007": ("Daglig leder eller styrets leder alene", ["CEO:1", "CHAIR:1"]),
    "R0008": ("Daglig leder og styrets leder i fellesskap", ["CEO:1;CHAIR:1"]),
    "R0009": ("Deltakerne i fellesskap", ["*ALL_PARTNERS"]),
    "R0010": ("Deltakerne hver for seg", ["PARTNER:1"]),
    "R0011": ("Styrets leder og nestleder hver for seg", ["CHAIR:1", "DEPUTY_CHAIR:1"]),
    "R0012": ("Styrets leder alene eller to styremedlemmer i fellesskap", ["CHAIR:1", "BOARD_MEMBER:2"]),
    "R0013": ("Daglig leder alene eller styrets medlemmer hver for seg", ["CEO:1", "BOARD_MEMBER:1"]),
    "R0014": ("Daglig leder og ett styremedlem i fellesskap", ["CEO:1;BOARD_MEMBER:1"]),
    "R0015": ("Styrets leder og nestleder i fellesskap", ["CHAIR:1;DEPUTY_CHAIR:1"]),
    "R0016": ("Tre styremedlemmer i fellesskap", ["BOARD_MEMBER:3"]),
    "R0017": ("Styrets leder og to styremedlemmer i fellesskap", ["CHAIR:1;BOARD_MEMBER:2"]),
    "R0018": ("Nestleder og ett styremedlem i fellesskap", ["DEPUTY_CHAIR:1;BOARD_MEMBER:1"]),
}
#: Further groups that rules may have, and the groups of the statutory defaults (fixed values).
MORE_GROUPS = ["CEO:2", "CEO:1;PROKURIST:1", "EXECUTIVE_MEMBER:1", "EXECUTIVE_MEMBER:2", "EXECUTIVE_MEMBER:1;PROKURIST:1", "PARTNER:2", "PROKURIST:2", "*ALL_EXECUTIVES"]
DEFAULTS = ["*ALL_BOARD", "PARTNER:1"]
STRUCTURAL = ("rule_type", "min_signers", *EXACT)


def parse_group(text: str) -> tuple[list[tuple[str, int]], str | None]:
    """('ROLE:n;…' or '*BODY') as a group."""
    if text.startswith("*"):
        return [], text[1:]
    return [(r, int(n)) for r, n in (p.split(":") for p in text.split(";"))], None


def rule_table(spark: SparkSession) -> DataFrame:
    """(code, description, alternatives) of RULES; a table of fixed size."""
    rows = [(c, d, [parse_group(g) for g in gs]) for c, (d, gs) in RULES.items()]
    return spark.createDataFrame(rows, f"code string, description string, alternatives array<{GROUP}>")


def group_key(g: Column) -> Column:
    """'ROLE:n;…' with roles in order; null for a whole body."""
    parts = F.array_sort(F.transform(g.getField("roles"), lambda r: F.concat_ws(":", r.getField("role"), r.getField("n").cast("string"))))
    return F.when(g.getField("collective").isNull(), F.array_join(parts, ";"))


def group_size(g: Column) -> Column:
    """Number of persons; null for a whole body."""
    return F.when(g.getField("collective").isNull(), F.aggregate(g.getField("roles"), F.lit(0), lambda s, r: s + r.getField("n")))


def by_office(alternatives: Column) -> Column:
    """Groups without a named signatory."""
    return F.filter(alternatives, lambda g: ~F.exists(F.coalesce(g.getField("roles"), F.array().cast("array<struct<role:string,n:int>>")), lambda r: r.getField("role") == "SIGNATORY"))


def rule_type(status: Column, alternatives: Column, person_specific: Column) -> Column:
    """The pattern of a rule."""
    alts = by_office(alternatives)
    sizes = F.transform(alts, group_size)
    one = F.coalesce(F.exists(sizes, lambda s: F.coalesce(s == 1, F.lit(False))), F.lit(False))
    every = F.forall(sizes, lambda s: F.coalesce(s == 1, F.lit(False)))
    g = F.get(alts, F.lit(0))
    roles = F.transform(g.getField("roles"), lambda r: r.getField("role"))
    general = F.array(*[F.lit(m) for m in MEMBERS])
    particular = F.array_except(roles, general)
    n = group_size(g)
    key = group_key(g)
    single = (
        F.when(g.getField("collective").isNotNull(), "board_jointly")
        .when(F.forall(roles, lambda r: r == "PROKURIST"), "prokura_only_rule")
        .when((n == 1) & (key == "CEO:1"), "sole_ceo")
        .when((n == 1) & (key == "CHAIR:1"), "sole_chair")
        .when((n == 1) & (F.size(particular) == 0), "sole_any_board_member")
        .when(n == 1, "sole_specific_roles")
        .when((n == 2) & (F.size(particular) == 0), "joint_two_any")
        .when((n == 2) & (F.size(particular) == F.size(F.array_distinct(roles))), "joint_two_specific")
        .when((n == 2) | (F.size(particular) > 0), "joint_role_combo")
        .otherwise("joint_three_plus")
    )
    several = F.when(every, "sole_specific_roles").when(one, "mixed_alternatives").otherwise("joint_alternatives")
    empty = F.when(~F.coalesce(person_specific, F.lit(False)), "no_rule_registered")
    k = F.coalesce(F.size(alts), F.lit(0))
    return F.when(status != "uninterpretable", F.when(k <= 0, empty).when(k >= 2, several).otherwise(single))


def min_signers(status: Column, alternatives: Column, statutory: Column | None = None) -> Column:
    """The least number of persons that suffice."""
    groups = F.coalesce(alternatives, F.array().cast(f"array<{GROUP}>"))
    if statutory is not None:
        groups = F.when((status == "none") & statutory.isNotNull(), F.array_append(groups, statutory)).otherwise(groups)
    least = F.array_min(F.transform(groups, group_size))
    out = F.when(F.size(groups) == 0, F.lit(None)).when(least.isNull(), "all_board").when(least <= 1, "1").when(least == 2, "2").otherwise("3+")
    return F.when(status != "uninterpretable", out)


def granted(alternatives: Column, keys: list[str]) -> Column:
    """Whether one of the groups is one of `keys`."""
    return F.coalesce(F.exists(alternatives, lambda g: F.coalesce(group_key(g).isin(keys), F.lit(False))), F.lit(False))


def exact_answer(question: str, status: Column, alternatives: Column, person_specific: Column) -> Column:
    yes = granted(alternatives, EXACT[question])
    return F.when(status != "uninterpretable", F.when(yes, True).when(~F.coalesce(person_specific, F.lit(False)), False))


def reachable(coalition: tuple[str, ...]) -> list[str]:
    """Keys of all groups that the persons of a coalition can fill: some of them, each in one of their seats."""
    keys = set()
    for k in range(1, len(coalition) + 1):
        for people in combinations(coalition, k):
            for seats in product(*(SEATS[p] for p in people)):
                keys.add(";".join(f"{r}:{n}" for r, n in sorted(Counter(seats).items())))
    return sorted(keys)


def coalition_answer(question: str, status: Column, alternatives: Column, person_specific: Column) -> Column:
    """Whether the coalition of a question suffices: some group is among those it can fill."""
    yes = granted(by_office(alternatives), reachable(COALITIONS[question]))
    return F.when(status == "rule", F.when(yes, True).when(~F.coalesce(person_specific, F.lit(False)), False))


def answers(status: Column, alternatives: Column, person_specific: Column, statutory: Column | None = None) -> dict[str, Column]:
    """All answers of a rule."""
    out = {"rule_type": rule_type(status, alternatives, person_specific), "min_signers": min_signers(status, alternatives, statutory)}
    out |= {q: exact_answer(q, status, alternatives, person_specific) for q in EXACT}
    return out | {q: coalition_answer(q, status, alternatives, person_specific) for q in COALITIONS} | {"parseable": status != "uninterpretable"}


def minimal_coalitions(said: dict[str, Column]) -> Column:
    """Names of the coalitions answered yes that contain no other one answered yes."""
    people = {q: Counter(p) for q, p in {**OLDER, **COALITIONS}.items() if q in said}
    parts = []
    for q, big in people.items():
        inner = [o for o, small in people.items() if o != q and sum(small.values()) < sum(big.values()) and all(big[r] >= n for r, n in small.items())]
        held = F.coalesce(said[q], F.lit(False))
        for o in inner:
            held = held & ~F.coalesce(said[o], F.lit(False))
        parts.append(F.when(held, q))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def universe(spark: SparkSession, named: bool = True) -> DataFrame:
    """Distinct answers (STRUCTURAL) of all rules with one to three groups, with and without a named signatory, and of the statutory defaults.

    Its size depends on the constants above alone (a few thousand rows), so it may be broadcast."""
    atoms = [parse_group(g) for g in sorted({g for _, gs in RULES.values() for g in gs} | set(MORE_GROUPS))]
    rules = [("rule", list(c), None) for k in (1, 2, 3) for c in combinations(atoms, k)] + [("none", [], parse_group(d)) for d in DEFAULTS]
    signatory = ([("SIGNATORY", 1)], None)
    rows = [(s, alts + [signatory] * person, d, bool(person)) for s, alts, d in rules for person in range(1 + named)]
    both = spark.createDataFrame(rows, f"status string, alts array<{GROUP}>, statutory {GROUP}, person boolean").coalesce(2)
    out = answers(F.col("status"), F.col("alts"), F.col("person"), F.col("statutory"))
    return both.select(*[out[q].cast("string").alias(q) for q in STRUCTURAL]).distinct()


def consistent(predicted: DataFrame, id: str, named: bool = True) -> DataFrame:
    """(id, consistent): whether some rule gives all the structural answers predicted (columns STRUCTURAL as strings, null: not asked).

    Fewer than two answers always fit. What a rule leaves open fits any prediction, but for its type. named: rules with a named signatory count too."""
    u = cut(universe(predicted.sparkSession, named))
    u = u.select(*[F.col(q).alias(f"u_{q}") for q in STRUCTURAL])
    keys = predicted.select(*STRUCTURAL).distinct()
    cond = F.lit(True)
    for q in STRUCTURAL:
        open_ = F.lit(False) if q == "rule_type" else F.col(f"u_{q}").isNull()
        cond = cond & (F.col(q).isNull() | open_ | (F.col(q) == F.col(f"u_{q}")))
    fits = keys.join(F.broadcast(u), cond, "left_semi").withColumn("_fits", F.lit(True))
    asked = sum((F.col(q).isNotNull().cast("int") for q in STRUCTURAL[1:]), F.col(STRUCTURAL[0]).isNotNull().cast("int"))
    alone = (F.coalesce(F.col("ceo_alone") == "true", F.lit(False))) | F.coalesce(F.col("chair_alone") == "true", F.lit(False))
    broken = (F.coalesce(F.col("ceo_alone") == "true", F.lit(False)) & F.coalesce(F.col("ceo_with_one_board_member") == "false", F.lit(False))) | (alone & F.coalesce(F.col("min_signers") != "1", F.lit(False)))
    same = F.lit(True)
    p, f = predicted.alias("p"), fits.alias("f")
    for q in STRUCTURAL:
        same = same & F.col(f"p.{q}").eqNullSafe(F.col(f"f.{q}"))
    j = p.join(f, same, "left").select(F.col(f"p.{id}").alias(id), *[F.col(f"p.{q}").alias(q) for q in STRUCTURAL], "_fits")
    return j.select(id, ((asked < 2) | (F.coalesce("_fits", F.lit(False)) & ~broken)).alias("consistent"))


def compose(texts: DataFrame, id: str, text: str) -> DataFrame:
    """(id, codes): texts all of whose parts, between sentence ends and 'eller', are descriptions of RULES."""
    from ..functions.text import text_key

    rules = rule_table(texts.sparkSession).select(text_key(F.col("description")).alias("part"), "code")
    said = F.filter(F.transform(F.split(F.col(text), r"(?i)(?:[.;]\s+|,?\s+eller\s+)"), lambda p: F.trim(F.regexp_replace(p, r"^[ .;,]+|[ .;,]+$", ""))), lambda p: p != "")
    parts = texts.select(id, F.posexplode(said).alias("i", "p")).select(id, "i", text_key(F.col("p")).alias("part"))
    j = parts.join(F.broadcast(rules), "part", "left")
    return j.groupBy(id).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("code")).alias("codes"), F.count("code").alias("k")).where("n = k").select(id, "codes")
