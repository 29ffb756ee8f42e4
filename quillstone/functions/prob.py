"""Functions of probability vectors and logits, as array expressions inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities are held above this before logarithms and powers.
FLOOR = 1e-12


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Softmax of logits / temperature, shifted by the maximum; -infinity gives 0. Null stays null."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.array_max(logits)
    e = F.transform(logits, lambda z: F.exp((z - top) / t))
    return F.transform(e, lambda x: x / _sum(e))


def temper(probs: Column, temperature: Column | float) -> Column:
    """Probabilities to the power 1/T, normalised anew."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    p = F.transform(probs, lambda x: F.pow(F.greatest(x, F.lit(FLOOR)), 1.0 / t))
    return F.transform(p, lambda x: x / _sum(p))


def argmax(probs: Column) -> Column:
    """Index of the first largest element."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def confidence(probs: Column) -> Column:
    return F.array_max(probs)


def expected_level(probs: Column) -> Column:
    """Mean of the index under the probabilities."""
    return _sum(F.transform(probs, lambda p, i: p * i))


def brier(probs: Column, y: Column) -> Column:
    """Sum of squared deviations from the indicator of y."""
    return _sum(F.transform(probs, lambda p, i: F.pow(p - F.when(i == y, 1.0).otherwise(0.0), F.lit(2.0))))


def nll(probs: Column, y: Column) -> Column:
    """Negative logarithm of the probability of y, held above FLOOR."""
    return -F.log(F.greatest(F.element_at(probs, y.cast("int") + 1), F.lit(FLOOR)))


def option_index(label: Column, keys: Column) -> Column:
    """Place of a label among the keys of its question, from 0; null if it is none of them."""
    at = F.array_position(keys, label)
    return F.when(at > 0, (at - 1).cast("int"))


def align_logits(values: Column, keys: Column) -> Column:
    """Logits of a map in the order of the keys; -infinity for options not offered."""
    return F.transform(keys, lambda k: F.coalesce(F.try_element_at(values, k).cast("double"), F.lit(float("-inf"))))


def percent(x: Column, digits: int = 1) -> Column:
    """'98.4 %'; a dash for null."""
    return F.when(x.isNull(), "–").otherwise(F.format_string(f"%.{digits}f %%", x * 100))


def percent_comma(x: Column, digits: int = 1) -> Column:
    """percent with a decimal comma."""
    return F.replace(percent(x, digits), F.lit("."), F.lit(","))
