"""Group aggregates.

Values are put back on rows by joining the aggregate instead of using a window over the raw group:
the aggregate is combined before the shuffle and the join can split a hot key, whereas a window would
bring a whole group to one task.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.functions.nulls import ratio, zero


def total(x) -> Column:
    """Sum in which missing counts as 0 and an empty sum is 0."""
    return zero(F.sum(x))


def total_if(x, cond: Column) -> Column:
    return zero(F.sum(F.when(cond, x)))


def mean_of(x: Column, w: Column) -> Column:
    """Weighted mean; a missing x counts as 0 with its weight."""
    return ratio(F.sum(x * w), F.sum(w))


def mean_of_known(x: Column, w: Column) -> Column:
    """Weighted mean in which rows with a missing x add no weight."""
    return ratio(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def share_of(w: Column, cond: Column) -> Column:
    return ratio(F.sum(F.when(cond, w).otherwise(0.0)), F.sum(w))


def collapse(df: DataFrame, by, **aggs: Column) -> DataFrame:
    return df.groupBy(*_cols(by)).agg(*[a.alias(n) for n, a in aggs.items()])


def with_group_values(df: DataFrame, by, **aggs: Column) -> DataFrame:
    """Each row with aggregates of its group; group keys may be missing."""
    return with_values_of_groups(df, (by, aggs))


def with_values_of_groups(df: DataFrame, *parts) -> DataFrame:
    """As :func:`with_group_values` for several (keys, aggregates): all are taken from ``df`` itself before anything is
    joined, so stacking them does not repeat the work of the joins before."""
    out = df
    for by, aggs in parts:
        by = _cols(by)
        grouped = df.groupBy(*[F.col(k).alias(f"__{k}") for k in by]).agg(*[a.alias(n) for n, a in aggs.items()])
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by])
        out = out.join(grouped, same, "left").drop(*[f"__{k}" for k in by])
    return out


def nvals(df: DataFrame, by, x: str, out: str = "n_values") -> DataFrame:
    return collapse(df, by, **{out: F.count_distinct(x)})


def mode_by(df: DataFrame, by, x: str, ties: str = "null", out: str | None = None) -> DataFrame:
    """Most frequent known value per group; on a tie: missing, the lowest or the highest value."""
    by, out = _cols(by), out or x
    counts = df.groupBy(*by, x).agg(F.count(x).alias("__n"))
    best = counts.groupBy(*by).agg(
        F.max(F.when(F.col(x).isNotNull(), F.struct("__n", x))).alias("__high"),
        F.max(F.when(F.col(x).isNotNull(), F.col("__n"))).alias("__top"),
        F.min_by(F.when(F.col(x).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(),
                                                               F.struct(-F.col("__n"), F.col(x)))).alias("__low"),
    )
    high, low = F.col("__high")[x], F.col("__low")
    value = {"null": F.when(high == low, high), "min": low, "max": high}[ties]
    return best.select(*by, value.alias(out))


def multiple_mode(df: DataFrame, by, x: str, multiple, out: str) -> DataFrame:
    """Mode in which a tie between known values becomes the ``multiple`` code; all-missing stays missing."""
    by = _cols(by)
    modes = mode_by(df, by, x, "null", out)
    known = collapse(df, by, __unknown=F.max(F.col(x).isNull().cast("int")))
    filled = F.when(F.col(out).isNull() & (F.col("__unknown") == 0), F.lit(multiple)).otherwise(F.col(out))
    return modes.join(known, by).withColumn(out, filled).drop("__unknown")


def share(df: DataFrame, by, x: str, out: str = "share") -> DataFrame:
    """x as a share of its group total."""
    if not _cols(by):
        whole = df.agg(F.sum(x)).scalar()
        return df.withColumn(out, ratio(F.col(x), whole))
    return with_group_values(df, by, __total=F.sum(x)).withColumn(
        out, ratio(F.col(x), F.col("__total"))).drop("__total")


def min_entropy(df: DataFrame, by, category: str, weight: str, out: str = "min_entropy") -> DataFrame:
    """``-ln(largest share)`` of the weight over categories."""
    by = _cols(by)
    per = df.groupBy(*by, category).agg(total(weight).alias("__w"))
    return per.groupBy(*by).agg((-F.try_divide(F.max("__w"), F.sum("__w"))).alias("__m")).select(
        *by, F.when(F.col("__m") < 0, -F.log(-F.col("__m"))).alias(out))


def rescale_to_total(df: DataFrame, by, x: str, wanted: str, out: str) -> DataFrame:
    """Scale x within the group up to ``wanted`` when the group total falls short of it."""
    with_total = with_group_values(df, by, __total=total(x))
    scaled = F.when(F.col("__total") < F.col(wanted), ratio(F.col(x) * F.col(wanted), F.col("__total")))
    return with_total.withColumn(out, F.coalesce(scaled, F.col(x))).drop("__total")


def max_low_missing(x: Column, stand_in: float = 0.01) -> Column:
    """Max in which missing ranks above 0 but below every other value, then is missing again."""
    top = F.max(F.coalesce(x, F.lit(stand_in)))
    return F.when(F.round(top, 2) != stand_in, top)


def reconcile_max(df: DataFrame, by, cols) -> DataFrame:
    """Replace attributes by their maximum over all rows of a code."""
    fixed = with_group_values(df, by, **{f"__max_{c}": F.max(c) for c in cols})
    return fixed.withColumns({c: F.col(f"__max_{c}") for c in cols}).drop(*[f"__max_{c}" for c in cols])


def rate_table(df: DataFrame, row: str, group: str, levels, y: str) -> DataFrame:
    """Mean of y by row category and group, groups as columns."""
    return df.groupBy(row).pivot(group, list(levels)).agg(F.avg(y))


def share_table(df: DataFrame, row: str, group: str, levels) -> DataFrame:
    """Group shares and the row count of each category."""
    counts = df.groupBy(row).pivot(group, list(levels)).agg(F.count(F.lit(1))).na.fill(0, list(levels))
    n = sum((F.col(g) for g in levels), F.lit(0))
    return counts.select(row, *[ratio(F.col(g), n).alias(g) for g in levels], n.cast("bigint").alias("n"))


def freq(df: DataFrame, cols) -> DataFrame:
    return df.groupBy(*_cols(cols)).agg(F.count(F.lit(1)).alias("n"))


def pick(df: DataFrame, keys, order, best: str = "first") -> DataFrame:
    """First or last row per key under a total order of columns, as an aggregate combined before the
    shuffle (so a hot key never reaches one task whole). Missing order values sort first."""
    keys = _cols(keys)
    rest = [c for c in df.columns if c not in keys]
    choose = F.min_by if best == "first" else F.max_by
    picked = choose(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(picked.alias("__p")).select(*keys, "__p.*")


def latest_source(df: DataFrame, entity: str, source: str = "source") -> DataFrame:
    """Rows of the most recent source of each entity."""
    last = df.groupBy(entity).agg(F.max(source).alias(source))
    return df.join(last, [entity, source], "left_semi")


def _cols(by):
    return [by] if isinstance(by, str) else list(by)
