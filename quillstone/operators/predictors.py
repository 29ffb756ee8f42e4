"""Baseline predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority_prior(items: DataFrame) -> DataFrame:
    """(qid, y, logit): logarithm of (count + 1) over their sum, for the options 0 to the highest answer of each question."""
    counts = items.groupBy("qid", "y").agg(F.count("*").alias("n"))
    top = counts.groupBy("qid").agg(F.max("y").alias("top"))
    grid = top.select("qid", F.explode(F.sequence(F.lit(0), "top")).alias("y"))
    full = grid.join(counts, ["qid", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    return full.select("qid", "y", F.log(F.col("n") / F.sum("n").over(Window.partitionBy("qid"))).alias("logit"))


def keyword_rule(text: Column, yes: list[str], no: list[str]) -> Column:
    """True if a word of `yes` stands in the text and none of `no`, false the other way round, else null."""

    def has(ws: list[str]) -> Column:
        return F.lower(text).rlike(rf"(?U)(?<!\w)({'|'.join(ws)})(?!\w)")

    return F.when(has(yes) & ~has(no), True).when(has(no) & ~has(yes), False)


def text_classifier(rows: DataFrame, text: str, label: str, n: int = 3, features: int = 1 << 16, c: float = 1.0):
    """A fitted pipeline of character n-grams inside words, TF-IDF and logistic regression on the labelled rows; None if they have fewer than two labels."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, StringIndexer

    known = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    if known.select(label).distinct().limit(2).count() < 2:
        return None
    stages = [
        HashingTF(inputCol="grams", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="x", minDocFreq=2),
        StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep"),
        LogisticRegression(featuresCol="x", labelCol="_y", maxIter=20, regParam=c / 1000),
    ]
    return Pipeline(stages=stages).fit(with_grams(known, text, n))


def with_grams(rows: DataFrame, text: str, n: int = 3) -> DataFrame:
    """Adds `grams`, the character n-grams of the blank-padded words of the text."""
    words = F.filter(F.split(F.lower(F.col(text)), r"(?U)\s+"), lambda w: w != "")
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) + 2 - n + 1, F.lit(1))), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(n)))))
    return rows.withColumn("grams", F.coalesce(grams, F.array().cast("array<string>")))
