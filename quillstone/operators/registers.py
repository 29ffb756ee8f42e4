"""Register extracts as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Organisation forms by tier, and those left out (fixed values).
TIERS = {1: ["AS", "ASA"], 2: ["ANS", "DA", "KS", "SA", "SE", "SPA", "STI", "IKS", "SF", "GFS", "ESEK", "PK", "BA"], 3: ["BRL", "BBL", "FLI"]}
EXCLUDED = ["ENK"]
#: Function codes of the Austrian register that represent, hold procuration, or wind up (fixed values).
REPRESENTING, PROCURATION, ABNORMAL = ("GF", "VM", "KP", "GL"), ("PR",), ("AB", "MW", "SV")

#: Shape of an extract; repeated and optional parts are arrays.
_ENTRY = "array<struct<_AUFRECHT:string,_VNR:string,DATVON:string,DATBIS:string,VART:struct<CODE:string,TEXT:string>,VSBEIDE:struct<CODE:string,TEXT:string>,TEXT:array<string>,TXTVERTR:array<string>>>"
EXTRACT = f"struct<_FNR:string,_UMFANG:string,_STICHTAG:string,FUN:array<struct<_PNR:string,_FKEN:string,_FKENTEXT:string,FU_DKZ10:{_ENTRY}>>>"


def scope(form: Column, deleted: Column) -> Column:
    """Tier of a form, or the reason why the entity is left out."""
    out = F.when(F.coalesce(deleted, F.lit("")) != "", "deleted")
    for tier, forms in TIERS.items():
        out = out.when(form.isin(forms), f"tier {tier}")
    return out.when(form.isin(EXCLUDED), "excluded").otherwise("out of scope")


def try_dates(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd.MM.yyyy", "d.M.yyyy", "yyyyMMdd", "dd/MM/yyyy")) -> Column:
    """A date in one of several styles; null if none fits."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)).cast("date") for f in formats])


def extract_functions(extracts: DataFrame, today: str = "2025-01-01") -> DataFrame:
    """One row a function entry in force: (extract_id, pnr, fken, vart, vsbeide, n_texts, wording), by the built-in XML reader.

    The wording is TEXT and what it lacks of TXTVERTR, else the text of the code; null if there is none.

    An entry counts unless it is superseded or ended by `today`; an extract that can't be read has no rows."""
    plain = F.regexp_replace(F.regexp_replace("body", r"(</?)\w+:", "$1"), r"\s\w+:(\w+=)", " $1")
    x = F.from_xml(plain, EXTRACT, {"attributePrefix": "_", "ignoreNamespace": "true", "mode": "PERMISSIVE"})
    fun = extracts.dropDuplicates(["extract_id"]).select("extract_id", F.explode(x.getField("FUN")).alias("f"))
    e = fun.select("extract_id", F.col("f._PNR").alias("pnr"), F.col("f._FKEN").alias("fken"), F.explode("f.FU_DKZ10").alias("e"))
    held = (F.coalesce(F.col("e._AUFRECHT"), F.lit("true")) != "false") & (F.coalesce(F.substring("e.DATBIS", 1, 10), F.lit("9999")) > today)
    said = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: t.isNotNull() & (F.trim(t) != ""))
    texts = F.size(said("e.TXTVERTR"))
    wording = join_fragments(F.concat(said("e.TEXT"), append_missing(F.array_join(said("e.TEXT"), ""), said("e.TXTVERTR"))))
    wording = F.coalesce(F.nullif(wording, F.lit("")), F.nullif(F.trim("e.VART.TEXT"), F.lit("")))
    return e.where(held).select("extract_id", "pnr", "fken", F.col("e.VART.CODE").alias("vart"), F.col("e.VSBEIDE.CODE").alias("vsbeide"), texts.alias("n_texts"), wording.alias("wording"))


def coded_answers(functions: DataFrame) -> DataFrame:
    """Answers that the codes alone decide, one row an extract; null where they don't."""
    f = functions.withColumn("free", (F.col("vart") == "E") & (F.col("n_texts") == 0))
    gf, pr, rep = F.col("fken") == "GF", F.col("fken").isin(*PROCURATION), F.col("fken").isin(*REPRESENTING)
    n = lambda c: F.count_if(c)
    a = f.groupBy("extract_id").agg(
        n(rep).alias("rep"), n(pr).alias("pr"), n(pr & (F.col("vart") == "G")).alias("pr_g"), n(pr & (F.col("vart") == "E")).alias("pr_e"), n(F.col("fken").isin(*ABNORMAL)).alias("abnormal"),
        n(gf).alias("gf"), n(gf & F.col("free")).alias("gf_free"), n(gf & (F.col("vart") == "G")).alias("gf_g"), n(rep & F.col("free")).alias("rep_free"),
    )
    normal = F.col("abnormal") == 0
    ceo = F.when(normal & (F.col("gf") > 0), F.when(F.col("gf") == F.col("gf_free"), True).when(F.col("gf") == F.col("gf_g"), False))
    joint = F.when(F.col("pr") > 0, F.when(F.col("pr") == F.col("pr_g"), True).when(F.col("pr") == F.col("pr_e"), False))
    return a.where("rep > 0").select("extract_id", (F.col("pr") > 0).alias("prokura_present"), joint.alias("prokura_joint"), ceo.alias("ceo_alone"), F.when(normal & (F.col("rep_free") > 0), "1").alias("min_signers"))


def join_fragments(fragments: Column) -> Column:
    """Wrapped lines as one text: a hyphen at a line's end goes if the next line begins in lower case and isn't und, oder or bzw; else a space stands between."""

    def add(acc: Column, f: Column) -> Column:
        glue = acc.endswith("-") & f.rlike(r"(?U)^\p{Ll}") & ~f.rlike("^(und |oder |bzw)")
        return F.when(f == "", acc).when(acc == "", f).when(glue, F.concat(F.regexp_replace(acc, "-$", ""), f)).otherwise(F.concat(acc, F.lit(" "), f))

    return F.aggregate(F.transform(fragments, lambda x: F.trim(F.coalesce(x, F.lit("")))), F.lit(""), add)


def append_missing(text: Column, extra: Column) -> Column:
    """Those of `extra` whose letters, without blanks and hyphens, don't stand in the text."""
    squeezed = F.regexp_replace(text, r"(?U)[\s\-]+", "")
    return F.filter(extra, lambda t: ~F.contains(squeezed, F.regexp_replace(t, r"(?U)[\s\-]+", "")))
