"""Term codes ``2YYT``: year = code div 10 + 1800, T = 2 spring, 3 summer, 4 fall."""

from pyspark.sql import Column, functions as F


def term_of_date(d: Column) -> Column:
    month = F.month(d)
    season = F.when(month <= 5, 2).when(month <= 8, 3).otherwise(4)
    return (10 * (F.year(d) - 1800) + season).cast("int")


def season(strm: Column) -> Column:
    return (strm % 10).cast("int")


def year_of(strm: Column) -> Column:
    return (F.floor(strm / 10) + 1800).cast("int")


def term_code(year: Column, season_: Column) -> Column:
    return (10 * (year - 1800) + season_).cast("int")


def fiscal_year(strm: Column) -> Column:
    """The aid year starts in summer, so spring belongs to the year before."""
    return F.when(season(strm) == 2, year_of(strm) - 1).otherwise(year_of(strm))


def last_window_term(first: Column) -> Column:
    """17th term of the six years that start at ``first``."""
    return (first + 60 - F.when(season(first) == 4, 2).otherwise(9)).cast("int")


def last_observed_term(first: Column) -> Column:
    """18th (last) term of the six years that start at ``first``."""
    return (first + F.when(season(first) == 2, 52).otherwise(59)).cast("int")


def previous_term(strm: Column) -> Column:
    return F.when(season(strm) == 2, strm - 8).otherwise(strm - 1).cast("int")


def nth_term(first: Column, current: Column) -> Column:
    """1-based consecutive number of ``current`` counted from ``first``, three terms a year."""
    years = F.floor((current - first) / 10)
    step = (current - first) - 10 * years
    step = F.when(step == 8, 1).when(step == 9, 2).otherwise(step)
    return (3 * years + step + 1).cast("int")


def term_at(first: Column, nth: Column) -> Column:
    """Inverse of :func:`nth_term`."""
    code = first + 10 * F.floor((nth - 1) / 3) + (nth - 1) % 3
    return F.when((code % 10).isin(5, 6), code + 7).otherwise(code).cast("int")


def year_slot(first: Column, current: Column) -> Column:
    return (F.floor((current - first) / 10) + 1).cast("int")


def slot_name(first: Column, current: Column) -> Column:
    """Bucket label ``fa1 … su6`` of a term relative to the first term."""
    label = F.when(season(current) == 2, "sp").when(season(current) == 3, "su").otherwise("fa")
    return F.concat(label, year_slot(first, current).cast("string"))


SLOTS = [f"{s}{y}" for y in range(1, 7) for s in ("fa", "sp", "su")]


def possible_main_terms(first: Column, current: Column) -> Column:
    """Number of fall and spring terms from ``first`` up to, not including, ``current``."""
    diff, f = current - first, season(first)
    step = diff % 10
    return F.coalesce(
        F.when(step == 0, diff / 5),
        F.when((step == 9) & (f == 3), (diff + 1) / 5 - 1),
        F.when((step == 9) & (f == 4), (diff + 1) / 5),
        F.when(step == 8, (diff + 2) / 5 - 1),
        F.when((step == 1) & (f == 3), (diff - 1) / 5),
        F.when((step == 1) & (f == 2), (diff - 1) / 5 + 1),
        F.when(step == 2, (diff - 2) / 5 + 1),
    )
