"""Text functions: words, keys, register numbers.

Composition to NFC and full case folding have no built-in function in Spark. Texts in which lower case
does the same as both (PLAIN characters only) are folded by built-in functions; only others go through an
Arrow UDF. Everything else is built in.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\W_]+")
#: White space of all kinds, as a Java pattern (fixed values).
BLANKS = r"(?U)[\s\x{00A0}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
#: Dash characters that text keys write as '-' (fixed values).
DASHES = "‐‑‒–—―−"

#: Any character outside those that NFC leaves as they are and that fold to their lower case (but for 'ß', which folds to 'ss'),
#: as a Java pattern: ASCII, letters of Latin-1 and Latin Extended-A without special cases, general punctuation.
NOT_PLAIN = r"[^\x{00}-\x{7F}\x{A0}-\x{B4}\x{B6}-\x{12F}\x{132}-\x{148}\x{14A}-\x{17E}\x{2010}-\x{2027}\x{2030}-\x{205E}]"


def fold(text: str | None) -> str:
    """NFC, then full case folding; null is ''."""
    if not text:
        return ""
    return (text if text.isascii() else unicodedata.normalize("NFC", text)).casefold()


def words(text: str | None) -> list[str]:
    """The longest runs of letters and digits of the folded text; null has none."""
    return WORD.findall(fold(text))


@F.pandas_udf(T.StringType())
def _words_joined(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else " ".join(words(t)))


def words_joined(c: Column | str) -> Column:
    """Words joined by single spaces; null is ''."""
    c = F.col(c) if isinstance(c, str) else c
    odd = c.rlike(NOT_PLAIN)
    lower = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    plain = F.trim(F.regexp_replace(lower, r"[^\p{L}\p{N}]+", " "))
    return F.coalesce(F.when(odd, _words_joined(F.when(odd, c))).otherwise(plain), F.lit(""))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Composed form; null stays null."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def folded(s: pd.Series) -> pd.Series:
    """Composed and case folded; null is ''."""
    return s.map(fold)


def spaced(c: Column) -> Column:
    """Every run of white space one space, trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def normalize_text(c: Column) -> Column:
    """Composed, every run of white space one space, trimmed; null stays null."""
    return spaced(nfc(c))


def folded_key(c: Column) -> Column:
    """Comparison key of a text that is folded: blanks and dashes unified, closing stops dropped."""
    return F.regexp_replace(F.translate(spaced(c), DASHES, "-" * len(DASHES)), r"[\s.]+$", "")


def text_key(c: Column) -> Column:
    """Comparison key: folded, blanks and dashes unified, closing stops dropped; null is ''."""
    return folded_key(folded(c))


def register_number(jurisdiction: Column, entity_id: Column) -> Column:
    """The register number of an entity: its digits; for AT its digits without leading zeros plus the
    check letter in lower case. Null where there is no digit, and for other jurisdictions."""
    digits = F.regexp_replace(entity_id, "[^0-9]", "")
    letter = F.lower(F.regexp_extract(entity_id, "[0-9][^0-9A-Za-z]*([A-Za-z])[^0-9]*$", 1))
    at = F.concat(F.regexp_replace(digits, "^0+(?=[0-9])", ""), letter)
    return F.when(digits == "", None).when(jurisdiction == "AT", at).when(jurisdiction.isin("NO", "DK"), digits)
