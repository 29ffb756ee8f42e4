"""Consensus labels from annotators who disagree, by message passing on the bipartite graph of items and annotators.

For each class against the rest, every vote is an edge with sign +1 (voted the class) or -1 (voted
another). An item's message to an annotator sums the signed messages of its other annotators; an
annotator's message to an item averages their agreement with their other items' messages, and a
quarter of the one before is mixed in, so that messages can't swing for ever. Messages start at 1, each question's are
scaled alike, and rounds go on until the annotators' averages settle in every question. The table of messages gives all results: what the first messages sum to (every
annotator counts alike) and what the settled ones sum to, by item and class, and a reliability by annotator.

The first sums single out the plurality; the label that has the highest one alone is the item's consensus, as the
task defines it. Where they tie, `label` is null and `scored_label` breaks the tie by the settled sums.

Items on which the same annotators gave the same answers exchange the same messages, so that messages run on
distinct patterns of votes, each with its number of items; a pattern is known by two 64-bit hashes that don't depend on
order. Each round has a sum by class of a pattern and a sum by annotator, both with partial aggregation; the
sums come back through joins that split hot keys, or by broadcast where there are at most MOST_BROADCAST annotators.
Rounds are cut by checkpoints.

Defined cases: of the rows of an item and annotator the one of highest seq counts (equal seq: the first in
order of its answers, so the outcome doesn't depend on row order), and none if that one is skipped; a
null seq is below all others; null items, annotators and answers are no votes; spellings of labels and
annotators are unified; items with one vote have a score but no label; messages that die out (no annotator shares
an item) keep their last values; messages that don't settle in `most_rounds` raise a warning, which leaves `label` as
it is; empty tables give empty ones.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import cut

#: Labels of the questions with a fixed set of classes.
AMBIGUITY = (0, 3)
#: Annotators and questions up to which their sums are broadcast; beyond, they are joined.
MOST_BROADCAST = 100_000


def spelling(c: Column) -> Column:
    """Lower case, blanks and hyphens as single underscores, trimmed; a plus sign follows its number directly."""
    blanks = F.trim(F.translate(F.lower(c), "_-\t\n\x0b\f\r", " " * 7))
    return F.replace(F.regexp_replace(blanks, " +", "_"), F.lit("_+"), F.lit("+"))


def current_votes(gold: DataFrame) -> DataFrame:
    """(item_id, annotator, question, label): the votes that count."""
    order = F.struct(F.coalesce(F.col("seq"), F.lit(-(1 << 62))), F.struct(*[F.col(c).cast("string") for c in ("skipped", "rule_type", "min_signers", "ambiguity")]))
    last = (
        gold.select("seq", "item_id", spelling(F.col("annotator")).alias("annotator"), "skipped", "rule_type", "min_signers", "ambiguity")
        .where("item_id is not null and annotator is not null")
        .groupBy("item_id", "annotator")
        .agg(F.max_by(F.struct("skipped", "rule_type", "min_signers", "ambiguity"), order).alias("r"))
        .where("not coalesce(r.skipped, false)")
    )
    scale = F.when(F.col("r.ambiguity").between(*AMBIGUITY), F.col("r.ambiguity").cast("string"))
    answers = F.array(
        F.struct(F.lit("rule_type").alias("question"), spelling(F.col("r.rule_type")).alias("label")),
        F.struct(F.lit("min_signers").alias("question"), spelling(F.col("r.min_signers")).alias("label")),
        F.struct(F.lit("ambiguity").alias("question"), scale.alias("label")),
    )
    return last.select("item_id", "annotator", F.explode(answers).alias("a")).select("item_id", "annotator", "a.*").where("label is not null and label <> ''")


def patterns(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (item_id, question, p) and edges (p, question, annotator, label, w): the votes of one item of each pattern p,
    with the number w of items that have it."""
    seen = [F.bit_xor(F.xxhash64("annotator", "label")).alias("h1"), F.bit_xor(F.xxhash64("label", F.lit(1), "annotator")).alias("h2")]
    items = votes.groupBy("item_id", "question").agg(*seen, F.count("*").alias("k"))
    items = cut(items.select("item_id", "question", F.xxhash64("question", "h1", "h2", "k").alias("p")))
    first = items.groupBy("p", "question").agg(F.min("item_id").alias("item_id"), F.count("*").alias("w"))
    return items, cut(votes.join(first, ["item_id", "question"]).select("p", "question", "annotator", "label", "w"))


def _summed() -> Column:
    return F.sum(F.col("sign") * F.col("y"))


def pass_messages(votes: DataFrame, most_rounds: int = 60, settled: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(p, label, w, n_all, n_votes, first, score) of every voted class of every pattern of `votes` (p, question, annotator,
    label, w), and (annotator, question, reliability, n_items). first and score are the sums of the first and of the settled messages.

    Edges of a pattern are laid out for the classes that have a vote in it; for all others every message has
    the sign -1 and none can win. Rounds carry hashes, a sign and two messages an edge; names come back at the end."""
    rater, cell = F.xxhash64("annotator", "question"), F.xxhash64("p", "label")
    cells = cut(votes.groupBy("p", "label").agg(F.count("*").alias("n_votes"), F.first("w").alias("w")).withColumn("i", cell))
    sizes = votes.groupBy("p").agg(F.collect_set("label").alias("classes"), F.count("*").alias("n_all"))
    raters = cut(votes.groupBy("annotator", "question").agg(F.sum("w").alias("n_items"), F.count("*").alias("k")).withColumn("a", rater))
    few = raters.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    laid = votes.join(sizes, "p").select("p", "w", F.xxhash64("question").alias("q"), rater.alias("a"), "n_all", F.explode("classes").alias("class"), F.col("label").alias("voted"))
    sign = F.when(F.col("class") == F.col("voted"), 1.0).otherwise(-1.0)
    edges = cut(laid.select(F.xxhash64("p", "class").alias("i"), "q", "a", "w", "n_all", sign.alias("sign"), F.lit(1.0).alias("y"), F.lit(1.0).alias("was")))
    first = cut(edges.groupBy("i").agg(_summed().alias("first"), F.max("n_all").alias("n_all")))
    for turn in range(most_rounds):
        # Items to annotators: x = sum of the others' signed messages.
        sums = edges.groupBy("i").agg(F.struct(_summed().alias("sx")).alias("g"), F.count("*").alias("k"))
        x = lookup_join(edges, sums, "i", "k", "g").select("i", "q", "a", "w", "n_all", "sign", "y", (F.col("g.sx") - F.col("sign") * F.col("y")).alias("x"))
        # Annotators to items: average agreement with the messages of all their other items.
        per = x.groupBy("a").agg(F.struct(F.sum(F.col("w") * F.col("sign") * F.col("x")).alias("sy"), F.sum("w").alias("n")).alias("g"), F.count("*").alias("k"))
        back = x.join(F.broadcast(per.select("a", "g")), "a") if few else lookup_join(x, per, "a", "k", "g")
        new = (F.col("g.sy") - F.col("sign") * F.col("x")) / F.greatest(F.col("g.n") - 1, F.lit(1))
        moved = cut(back.select("i", "q", "a", "w", "n_all", "sign", (0.75 * new + 0.25 * F.col("y")).alias("y"), F.col("y").alias("was")))
        # How far the annotators' averages of a question, as a vector of length 1, have moved.
        mean = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
        means = moved.groupBy("q", "a").agg(mean("y").alias("n"), mean("was").alias("b"))
        dots = [F.sum(F.col(x) * F.col(y)).alias(x + y) for x, y in ("nb", "nn", "bb")]
        by_question = [t for t in means.groupBy("q").agg(*dots).collect() if t["nn"] and t["bb"]]  # one row a question
        if not by_question:
            break
        scale = F.coalesce(*[F.when(F.col("q") == t["q"], F.lit(t["nn"] ** 0.5)) for t in by_question], F.lit(1.0))
        edges = moved.withColumn("y", F.col("y") / scale)
        if all(2 - 2 * t["nb"] / (t["nn"] * t["bb"]) ** 0.5 <= settled**2 for t in by_question):
            break
    else:
        warnings.warn(f"messages between items and annotators did not settle in {most_rounds} rounds", RuntimeWarning, stacklevel=2)
    summed = edges.groupBy("i").agg(_summed().alias("score")).join(first, "i")
    trusted = edges.groupBy("a").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("reliability"))
    trust = raters.join(trusted, "a").select("annotator", "question", "reliability", "n_items")
    return cells.join(summed, "i").drop("i"), trust


def consensus(gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items: (item_id, question, label, scored_label, n_votes, agreement); annotators: (annotator, question, reliability, n_items).

    agreement is the share of the pairs of votes on the item that are equal; the reliabilities of a question are scaled to length 1."""
    items, votes = patterns(cut(current_votes(gold)))
    cells, trust = pass_messages(votes)
    level = cells.groupBy("p", "first").agg(
        F.count("*").alias("k"), F.max(F.struct("score", "label")).alias("best"), F.first("w").alias("w"), F.first("n_all").alias("n_all"), F.sum(F.col("n_votes") * (F.col("n_votes") - 1)).alias("same")
    )
    per = level.groupBy("p").agg(F.max(F.struct("first", "k", "best")).alias("top"), F.first("w").alias("w"), F.first("n_all").alias("n_all"), F.sum("same").alias("same"))
    decided = F.struct(
        F.when((F.col("n_all") >= 2) & (F.col("top.k") == 1), F.col("top.best.label")).alias("label"),
        F.col("top.best.label").alias("scored_label"),
        F.col("n_all").alias("n_votes"),
        F.when(F.col("n_all") >= 2, F.col("same") / (F.col("n_all") * (F.col("n_all") - 1))).alias("agreement"),
    )
    out = lookup_join(items, cut(per.select("p", "w", decided.alias("d"))), "p", "w", "d")
    return out.select("item_id", "question", "d.*"), trust
