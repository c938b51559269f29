"""Aggregates that Spark lacks, as expressions of those it has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def geometric_mean(c: Column | str) -> Column:
    """exp(mean(ln x)); a value that is not positive is an error, as it has no logarithm."""
    x = _d(c)
    return F.exp(F.avg(F.when(x > 0, F.ln(x)).when(x.isNull(), None).otherwise(F.raise_error(F.lit("geometric mean of a value that is not positive")).cast("double"))))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """sum(x w) / sum(w): weights of what is present count as one; null if they sum to 0."""
    return F.try_divide(F.sum(_d(value) * _d(weight)), F.sum(_d(weight)))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 if whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percent_error(ours: Column, theirs: Column) -> Column:
    """|ours - theirs| / theirs * 100, 0 where theirs is 0."""
    return F.when(theirs == 0, 0.0).otherwise(F.abs(ours - theirs) / theirs * 100)
