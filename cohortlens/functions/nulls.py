"""Missing-value rules: the data treats a missing number as larger than any number and a
missing string as the empty string, so every condition here is total (never NULL)."""

from pyspark.sql import Column, functions as F


def is_true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def below(x: Column, k) -> Column:
    """``x < k`` where a missing x is not below anything."""
    return F.coalesce(x < k, F.lit(False))


def above(x: Column, k) -> Column:
    """``x > k`` where a missing x is above everything."""
    return F.coalesce(x > k, F.lit(True))


def text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def in_list(x: Column, values) -> Column:
    """Membership with a missing string seen as ``''``; safe to negate."""
    return text(x).isin(list(values))


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` that is missing, not an error, when the denominator is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def flag(cond: Column) -> Column:
    return is_true(cond).cast("int")


def first_of(*cases, default=None) -> Column:
    """First value whose condition holds: ``first_of((cond, value), ..., default=v)``."""
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if default is None else out.otherwise(default)
