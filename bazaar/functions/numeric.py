"""Column expressions and aggregates that stay defined on awkward input."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that reads as a number: optional sign, digits, optional exponent.
NUMBER_PATTERN = r"^\s*+[+-]?(?:(?:\d++\.?\d*+|\.\d++)(?:[eE][+-]?\d++)?|(?i:inf|infinity))\s*+$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_present(columns: Iterable[str]) -> Column:
    """Whether none of the columns is null: a test scans can push down."""
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).isNotNull()
    return test


def no_nan(c: str | Column) -> Column:
    """Null instead of NaN, so a missing value has one form only."""
    return F.when(~F.isnan(col(c)), col(c))


def to_number(c: str | Column) -> Column:
    """Text to double; whatever is not a plain number becomes null."""
    text = col(c).cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null when the denominator is zero or null."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def pearson(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over rows where both sides are present.

    The built-in ``corr`` divides by zero on a constant column under ANSI
    rules; this form yields null there.
    """
    a, b = col(x), col(y)
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
