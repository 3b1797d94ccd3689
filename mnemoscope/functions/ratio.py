"""Ratios whose zero denominators are NULL, and conditional counts."""

from pyspark.sql import functions as F


def ratio(numerator, denominator):
    """numerator / denominator as double; NULL when the denominator is 0 or NULL."""
    return F.try_divide(F.col(numerator).cast("double") if isinstance(numerator, str) else numerator.cast("double"),
                        F.col(denominator).cast("double") if isinstance(denominator, str) else denominator.cast("double"))


def count_where(condition):
    """How many rows satisfy a condition; NULL counts as not satisfied and an empty input gives 0."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def holds(condition):
    """A rule's condition with NULL read as false, so that a missing field never passes."""
    return F.coalesce(condition, F.lit(False))
