"""Records that differ only in writing or order, collapsed by progressive partition refinement.

One scan gives every row a narrow record: its id, two classes and a key, all hashes. Three rounds then refine
the partition, each only inside the classes that still have several members:

1. cheap invariants, which equal records are bound to share: the plain key columns, the number of letters and
   digits of each text, and the size and total of the bag;
2. the histogram of the letters and digits of each text;
3. the key itself: words in order, plain columns and the sorted bag, as 128 bits.

Rows that are alone in their class are done, so their keys never cross a shuffle. Texts are folded and hashed by
built-in functions where their characters allow it and don't leave their scan. Classes are counted with
partial aggregation, and class values return through `lookup_join`, so that a class with a third of all rows
is never gathered in a task.

Defined cases: null texts are read as '', null plain keys equal each other only, a null bag is an empty
one, and a row with a null id is skipped; rows that repeat one id with equal content count once; texts of
any length are read whole; empty tables give empty ones; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words_joined
from ..operators.skew import lookup_join
from ..session import cut

#: Letters and digits whose counts make up the histogram; all others share one count.
COUNTED = "etanrs"


def histogram(letters: Column) -> Column:
    """How often each of COUNTED occurs in a text of letters and digits, as an array of counts."""
    n = F.length(letters)
    return F.array(*[n - F.length(F.translate(letters, c, "")) for c in COUNTED])


def _several(rows: DataFrame, level: str) -> DataFrame:
    """The rows whose class at `level` has more than one id."""
    sizes = rows.groupBy(level).agg(F.count("*").alias("_n"), F.min("_id").alias("_lo"), F.max("_id").alias("_hi"))
    return lookup_join(rows, sizes.where("_lo < _hi"), level, "_n", "_lo").drop("_lo")


def collapse(df: DataFrame, id: str, texts: list[Column], plain: list[Column], bag: Column) -> DataFrame:
    """(id, first_id, n_copies) of every row that has copies: the smallest id of its group and the group's size.

    `bag` is an array of structs (k string, n int) whose order doesn't matter."""
    t, p = [f"_t{i}" for i in range(len(texts))], [f"_p{i}" for i in range(len(plain))]
    bag_type = "array<struct<k:string,n:int>>"
    rows = df.select(
        F.col(id).cast("bigint").alias("_id"),
        *[words_joined(c.cast("string")).alias(a) for a, c in zip(t, texts)],
        *[c.cast("string").alias(a) for a, c in zip(p, plain)],
        F.coalesce(F.array_sort(bag.cast(bag_type)), F.array().cast(bag_type)).alias("_bag"),
    ).where("_id is not null")
    letters = [f"_l{i}" for i in range(len(texts))]
    rows = rows.select("*", *[F.translate(x, " ", "").alias(a) for x, a in zip(t, letters)])
    total = F.expr("aggregate(_bag, 0L, (a, x) -> a + coalesce(x.n, 0))")
    cheap = F.xxhash64(*p, *[F.length(x) for x in letters], F.size("_bag"), total)
    key = F.md5(F.to_json(F.struct(*p, *t, "_bag")))
    narrow = cut(rows.select("_id", cheap.alias("_cheap"), F.xxhash64(cheap, *[histogram(F.col(x)) for x in letters]).alias("_letters"), key.alias("_key")))

    several = _several(_several(narrow, "_cheap"), "_letters")
    keyed = cut(several.select("_id", "_key").distinct())
    groups = keyed.groupBy("_key").agg(F.count("*").alias("n_copies"), F.min("_id").alias("_lo"))
    groups = groups.where("n_copies > 1").select("_key", "n_copies", F.struct(F.col("_lo").alias("first_id"), "n_copies").alias("_g"))
    return lookup_join(keyed, groups, "_key", "n_copies", "_g").select(F.col("_id").alias(id), "_g.first_id", "_g.n_copies")


def member_copies(members: DataFrame) -> DataFrame:
    """(member_id, first_id, n_copies) of the members with text that have copies."""
    state = F.col("request.state")
    bag = F.transform(state.getField("roles"), lambda x: F.struct(x.getField("role").alias("k"), x.getField("count").alias("n")))
    return collapse(
        members.where("has_text"),
        "member_id",
        texts=[F.col("signature_key"), F.col("procuration_key")],
        plain=[F.col("jurisdiction"), state.getField("legal_form")],
        bag=bag,
    )
