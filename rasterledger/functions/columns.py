"""Column helpers used across operators. All stay inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(value, high))


def bankers(value: Column) -> Column:
    """Round half to even, as whole number."""
    return F.bround(value.cast("double"), 0).cast("bigint")


def half_up(value: Column) -> Column:
    """Round half towards positive infinity, as whole number."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def one_of(value: Column, names) -> Column:
    return value.isin(list(names))


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def count_hits(text: Column, words) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


#: What a cast takes may stand here only: blanks and control characters around, then digits, or the beginning of a number.
WHOLE = r"^[\x00-\x20\x7F]*[+-]?[0-9]+[\x00-\x20\x7F]*$"
NUMERIC = r"^[\x00-\x20\x7F]*[+-]?[0-9.iInN]"


def whole_number(text: Column) -> Column:
    """A text as BIGINT, null where it is none. A cast that fails raises inside, which costs far more than a look at the text."""
    return F.when(text.rlike(WHOLE), text.try_cast("bigint"))


def number(text: Column) -> Column:
    """A text as DOUBLE, null where it is none; see ``whole_number``."""
    return F.when(text.rlike(NUMERIC), text.try_cast("double"))


def lookup(key: Column, mapping: dict, default=None) -> Column:
    """Small constant map as a chain of ``when``; nothing is shipped or joined."""
    out = None
    for name, value in mapping.items():
        out = F.when(key == name, F.lit(value)) if out is None else out.when(key == name, F.lit(value))
    if default is None:
        return out
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def rank_of(value: Column, ranks: dict, default: int) -> Column:
    return F.coalesce(lookup(value, ranks), F.lit(default))


def name_of(rank: Column, ranks: dict) -> Column:
    return lookup(rank, {v: k for k, v in ranks.items()})


def blank(value: Column) -> Column:
    """True when a text is missing or only spaces."""
    return F.coalesce(F.trim(value), F.lit("")) == ""


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def round_even(value: Column, digits: int) -> Column:
    """Round a double on its binary value, halves to the even digit."""
    scale = 10.0 ** digits
    return F.bround(value * scale, 0) / F.lit(scale)


def round_to(value: Column, digits: int) -> Column:
    """Round a double on its binary value (``F.round`` rounds its shortest text)."""
    scale = 10.0 ** digits
    return F.floor(value * scale + 0.5) / F.lit(scale)
