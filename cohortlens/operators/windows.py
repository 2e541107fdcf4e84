"""Ordered rules over the terms of an entity.

Every function expects one row per (entity, term): aggregate first, so a window partition holds at
most one row per calendar term whatever the number of source rows of an entity.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.nulls import ratio
from cohortlens.operators.aggs import _cols, with_group_values


def over(entity, time="strm"):
    return Window.partitionBy(*_cols(entity)).orderBy(time)


def earlier(entity, time="strm"):
    return over(entity, time).rowsBetween(Window.unboundedPreceding, -1)


def through(entity, time="strm"):
    return over(entity, time).rowsBetween(Window.unboundedPreceding, 0)


def onward(entity, time="strm"):
    return over(entity, time).rowsBetween(0, Window.unboundedFollowing)


def term_index(entity, time="strm") -> Column:
    return F.row_number().over(over(entity, time))


def lag_term(x: str, k: int, entity, time="strm") -> Column:
    return F.lag(x, k).over(over(entity, time))


def running_sum(x, entity, time="strm") -> Column:
    return F.sum(x).over(through(entity, time))


def running_ratio(num, den, entity, time="strm") -> Column:
    return ratio(running_sum(num, entity, time), running_sum(den, entity, time))


def prior_share(num, den, entity, time="strm") -> Column:
    """Cumulative share through the term before."""
    return ratio(F.sum(num).over(earlier(entity, time)), F.sum(den).over(earlier(entity, time)))


def expanding_sd(x, entity, time="strm") -> Column:
    """Standard deviation over strictly earlier terms."""
    return F.stddev_samp(x).over(earlier(entity, time))


def ever(x, entity, time="strm", inclusive: bool = True) -> Column:
    return F.max(x).over(through(entity, time) if inclusive else earlier(entity, time))


def locf(x, entity, time="strm") -> Column:
    return F.last(x, ignorenulls=True).over(through(entity, time))


def nocb(x, entity, time="strm") -> Column:
    return F.first(x, ignorenulls=True).over(onward(entity, time))


def fill_prev_once(x: str, entity, time="strm") -> Column:
    """Fill a gap from the row before only; a filled value is not passed on."""
    return F.coalesce(F.col(x), F.lag(x).over(over(entity, time)))


def fill_first_known(x: str, entity, time="strm") -> Column:
    """Fill a gap with the first known value of the entity."""
    whole = over(entity, time).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.col(x), F.first(x, ignorenulls=True).over(whole))


def fill_if_unique(df: DataFrame, keys, x: str) -> DataFrame:
    """Fill missing x where the group has exactly one distinct known value; works on raw rows."""
    df = with_group_values(df, keys, __lo=F.min(x), __hi=F.max(x))
    only = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo"))
    return df.withColumn(x, F.coalesce(F.col(x), only)).drop("__lo", "__hi")


def trailing_mean(df: DataFrame, keys, terms: Column, num: str, den: str, span: int = 50, time="strm") -> DataFrame:
    """Weighted mean over ``target - span <= term < target`` for every target term of the calendar.

    Each term's total is sent to the target terms that can see it (at most ``span`` codes ahead), so
    the work is one aggregate; ``terms`` is the calendar array.
    """
    per = df.groupBy(*_cols(keys), time).agg(F.sum(num).alias("__num"), F.sum(den).alias("__den"))
    seen_by = F.filter("__terms", lambda t: (t > F.col(time)) & (t <= F.col(time) + span))
    return (
        per.withColumn("__terms", terms).withColumn("__target", F.explode(seen_by))
        .groupBy(*_cols(keys), F.col("__target").alias(time))
        .agg(ratio(F.sum("__num"), F.sum("__den")).alias("avg_grade"))
    )


def best_suffix_trend(df: DataFrame, entity: str, time: str, x: str, out: str = "trend") -> DataFrame:
    """Slope of the best-fitting recent run of earlier values.

    With n known earlier values: n < 2 gives 0, n = 2 their difference, and n >= 3 the least-squares
    slope of the suffix of length >= 3 with the highest R² (longest suffix on a tie, R² of a constant
    suffix is 1). Running sums come from windows; the sums of a suffix are those of all earlier values less
    those before its start, so a row does one step for each suffix. The array of sums is bounded by the calendar.
    """
    v = F.col(x).cast("double")
    seen = F.when(v.isNotNull(), F.count(v).over(earlier(entity, time)).cast("double"))
    upto = lambda value: F.coalesce(F.sum(value).over(earlier(entity, time)), F.lit(0.0))
    past = F.collect_list(F.when(F.col("__v").isNotNull(), F.struct("__v", "__sv", "__stv", "__svv"))).over(earlier(entity, time))
    n = F.size("__l")

    def fit(start):
        """Sums of the suffix after ``start`` values; its positions count from 0."""
        before = F.get("__l", start)
        m, s = (n - start).cast("double"), start.cast("double")
        sv, svv = F.col("__sv") - before["__sv"], F.col("__svv") - before["__svv"]
        return F.struct(m.alias("m"), (m * (m - 1) / 2).alias("st"), sv.alias("sv"), (m * (m - 1) * (2 * m - 1) / 6).alias("stt"),
                        (F.col("__stv") - before["__stv"] - s * sv).alias("stv"), svv.alias("svv"), start.alias("start"))

    def score(s):
        sxy = s["m"] * s["stv"] - s["st"] * s["sv"]
        sxx = s["m"] * s["stt"] - s["st"] * s["st"]
        syy = s["m"] * s["svv"] - s["sv"] * s["sv"]
        constant = syy <= 1e-9
        r2 = F.when(constant, 1.0).otherwise(F.round(F.try_divide(sxy * sxy, sxx * syy), 9))
        slope = F.when(constant, 0.0).otherwise(F.try_divide(sxy, sxx))
        return F.struct(r2.alias("r2"), (-s["start"]).alias("late"), slope.alias("slope"))

    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3))
    best = F.array_max(F.transform(F.transform(starts, fit), score))
    value = (
        F.when(n < 2, 0.0)
        .when(n == 2, F.get("__l", F.lit(1))["__v"] - F.get("__l", F.lit(0))["__v"])
        .otherwise(best["slope"])
    )
    sums = df.withColumns({"__v": v, "__t": seen}).withColumns(
        {"__sv": upto("__v"), "__stv": upto(F.col("__t") * F.col("__v")), "__svv": upto(F.col("__v") * F.col("__v"))})
    return sums.withColumn("__l", past).withColumn(out, value).drop("__l", "__v", "__t", "__sv", "__stv", "__svv")


def leave_one_out(df: DataFrame, by, x: str, w: str, out: str) -> DataFrame:
    """Weighted mean of the other rows of the group, by subtraction."""
    xw = F.col(x) * F.col(w)
    df = with_group_values(df, by, __sxw=F.sum(xw), __sw=F.sum(w))
    others = ratio(F.col("__sxw") - xw, F.col("__sw") - F.col(w))
    return df.withColumn(out, others).drop("__sxw", "__sw")
