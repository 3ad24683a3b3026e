"""Null-safe arithmetic helpers (ANSI mode raises on a zero divisor)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as double, NULL for a zero or NULL divisor."""
    return as_column(num).cast("double") / F.nullif(as_column(den).cast("double"), F.lit(0.0))


def to_number(c: Column | str) -> Column:
    """Numeric coercion: unreadable text and NaN become NULL."""
    value = as_column(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def sigmoid(z: Column) -> Column:
    """Logistic function, written so that neither tail overflows."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))
