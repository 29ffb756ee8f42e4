"""Keys, hashes and hash-based choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_hash(*parts: Column) -> Column:
    """Uniform number in [0, 1] from the first 32 bits of the SHA-256 of the parts joined by ':'."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def hash_split(key: Column, shares: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 13) -> Column:
    """train, val or test by a hash of the key alone, so that a key keeps its part as data grow. Null key: null."""
    h = unit_hash(F.lit(seed), key)
    a, b = shares[0], round(shares[0] + shares[1], 12)
    return F.when(key.isNull(), None).when(h < a, "train").when(h < b, "val").otherwise("test")


def cluster_key(*parts: Column, length: int = 16) -> Column:
    """Short digest of parts; null parts are read as ''."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, length)


def roles_signature(roles: Column, name: str = "role", count: str = "count") -> Column:
    """'role:count;…' in the order of the array; null is ''."""
    return F.coalesce(F.array_join(F.transform(roles, lambda r: F.concat_ws(":", r.getField(name), r.getField(count).cast("string"))), ";"), F.lit(""))


def ascii_key(c: Column) -> Column:
    """Lower-case letters and digits of a key, with accents of the northern languages dropped."""
    plain = F.replace(F.translate(F.lower(c), "øåäöüõ", "oaaouo"), F.lit("æ"), F.lit("ae"))
    return F.regexp_replace(plain, "[^a-z0-9]", "")


def template_key(c: Column, mark: str = "<DATE>") -> Column:
    """Text with dates (dd.mm.yyyy or ISO) as a mark."""
    return F.regexp_replace(c, r"\b(\d{1,2}\.\d{1,2}\.\d{4}|\d{4}-\d{2}-\d{2})\b", mark)


def phrase_key(c: Column) -> Column:
    """Lower case, single spaces, no closing punctuation, no leading '(gemeinsam) mit'."""
    flat = F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(flat, r"[.,;:]+$", ""), r"^(gemeinsam )?mit ", ""))


def compact(c: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(c, r"(?U)\s", ""))


def prefix(c: Column, n: int = 3) -> Column:
    """First characters of an id, as a partition column."""
    return F.substring(c, 1, n)


def repeats(n: Column) -> Column:
    """Times a row with n duplicates is repeated in training: the root of n, rounded half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.sqrt(n)).cast("int"))


def bucket(length: Column, bounds: list[int], inclusive: bool = False, names: list[str] | None = None) -> Column:
    """Length class: the first bound that the length is below (or not above, if inclusive)."""
    sign = "<=" if inclusive else "<"
    names = names or [f"{sign}{b}" for b in bounds] + [f"{'>' if inclusive else '>='}{bounds[-1]}"]
    out = F.when(length.isNull(), F.lit("none"))
    for b, n in zip(bounds, names):
        out = out.when(length <= b if inclusive else length < b, n)
    return out.otherwise(names[-1])
