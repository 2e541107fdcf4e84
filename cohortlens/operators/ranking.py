"""Order statistics over groups of any size.

A window over a whole group would sort it in one task. Here values are first counted per distinct
value, the distinct values are cut into ranges at approximate quantiles, range totals give each range
its starting offset, and only the values of one range are ordered together. Results are exact: the
approximate cuts only decide how the work is split.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohortlens.functions.codes import seeded_key
from cohortlens.operators.aggs import _cols


def cut_count(spark: SparkSession) -> int:
    """Number of cut points: a power of two minus one, four ranges per shuffle partition."""
    return (1 << max(3, (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length() - 1)) - 1


def edges_below(x: Column, edges: Column, n_edges: int) -> Column:
    """How many sorted edges lie strictly below x, by binary search; ``n_edges`` is 2^k - 1."""
    steps = [1 << i for i in reversed(range(n_edges.bit_length()))]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda i, step: F.when(F.element_at(edges, i + step) < x, i + step).otherwise(i))
    return F.coalesce(found, F.lit(0))  # never NULL, so no null filter is pushed down to the scan


def _with_ranges(per: DataFrame, x: str) -> DataFrame:
    """Add the range number ``__range`` of x. The cut points are read from the same aggregate that is
    cut (all of its columns are used, so both share one shuffle)."""
    n = cut_count(per.sparkSession)
    probs = [i / (n + 1) for i in range(1, n + 1)]
    cuts = F.percentile_approx(x, F.lit(probs), F.lit(max(10000, 4 * n))).alias("cuts")
    used = [F.max(c).alias(c) for c in per.columns if c != x]
    row = per.agg(F.struct(cuts, *used)).scalar()
    return per.withColumn("__e", row).withColumn(
        "__range", edges_below(F.col(x), F.col("__e")["cuts"], n)).drop("__e")


def cumulate(df: DataFrame, by, x: str, sums: dict | None = None) -> DataFrame:
    """One row per (by, distinct x) with its count ``n``, sums, and running ``cum_*`` in order of x.

    Rows with a missing x are left out.
    """
    by, sums = _cols(by), sums or {}
    per = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    return cumulate_counts(per, by, x, ["n", *sums])


def cumulate_counts(per: DataFrame, by, x: str, names) -> DataFrame:
    """As :func:`cumulate`, from rows that are counted already: one for each (by, x), with the counts ``names``."""
    by, names = _cols(by), list(names)
    per = _with_ranges(per, x)
    totals = per.groupBy(*by, "__range").agg(*[F.sum(k).alias(f"__t_{k}") for k in names])
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__range", *[
        F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in names])
    within = Window.partitionBy(*by, "__range").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    return per.join(offsets, [*by, "__range"]).select(
        *by, x, *names, *[(F.col(f"__o_{k}") + F.sum(k).over(within)).alias(f"cum_{k}") for k in names])


def quantiles(df: DataFrame, by, x: str, probs, out: str = "q") -> DataFrame:
    """Exact linearly interpolated quantiles: one row per group and probability."""
    by = _cols(by)
    c = cumulate(df, by, x)
    sizes = c.groupBy(*by).agg(F.max("cum_n").alias("__size"))
    wanted = sizes.select(*by, "__size", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    wanted = wanted.withColumn("__pos", F.col("prob") * (F.col("__size") - 1))
    wanted = wanted.withColumns({"__lo": F.floor("__pos"), "__hi": F.ceil("__pos")})
    # value at 0-based position k is the x with cum_n - n <= k < cum_n
    plain = c.withColumn("__from", F.col("cum_n") - F.col("n"))
    positions = [*by, "__size", "prob", "__pos", "__lo", "__hi"]
    requests = wanted.groupBy(*by).agg(F.collect_list(F.struct("prob", "__pos", "__lo", "__hi")).alias("__req"))
    joined = plain.join(requests, by) if by else plain.withColumn(
        "__req", requests.select("__req").scalar())
    hits = joined.select(*by, x, "n", "cum_n", "__from", F.explode(F.filter("__req", lambda r: (
        (r["__lo"] >= F.col("__from")) & (r["__lo"] < F.col("cum_n"))) | (
        (r["__hi"] >= F.col("__from")) & (r["__hi"] < F.col("cum_n"))))).alias("__r"))
    at = lambda k: F.max(F.when((F.col("__r")[k] >= F.col("__from")) & (F.col("__r")[k] < F.col("cum_n")), F.col(x)))
    ends = hits.groupBy(*by, F.col("__r.prob").alias("prob")).agg(
        at("__lo").alias("__a"), at("__hi").alias("__b"), F.max(F.col("__r.__pos")).alias("__pos"))
    frac = F.col("__pos") - F.floor("__pos")
    return ends.select(*by, "prob", (F.col("__a") + (F.col("__b") - F.col("__a")) * frac).alias(out))


def nth_smallest(df: DataFrame, by, x: str, n: Column, out: str = "value") -> DataFrame:
    """n-th smallest x per group; ``n`` may use the group columns and must be at least 1."""
    c = cumulate(df, by, x)
    return c.where(F.col("cum_n") >= n).groupBy(*_cols(by)).agg(F.min(x).alias(out))


def ordinal_rank(df: DataFrame, by, x: str | None, ids, seed=0, out: str = "rank", sums: dict | None = None) -> DataFrame:
    """1-based rank within the group in order of x, ties in order of a seeded key, then id.

    Rows that share x are spread over key prefixes, so neither a hot group nor a hot value meets in one
    task. With ``x=None`` the order is that of the seeded key: a reproducible shuffle. ``sums`` adds
    running totals ``cum_*`` in the same order.
    """
    by, ids, sums = _cols(by), _cols(ids), sums or {}
    names = ["n", *sums]
    rows = df.withColumn("__key", seeded_key(seed, *[F.col(i) for i in ids])).withColumn(
        "__p", F.substring("__key", 1, 3))
    if x is not None:
        rows = rows.where(F.col(x).isNotNull())
    value = [] if x is None else [x]
    cell = [*by, *value, "__p"]
    per = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    per = per.withColumn("__range", F.lit(0)) if x is None else _with_ranges(per, x)
    totals = per.groupBy(*by, "__range").agg(*[F.sum(k).alias(f"__t_{k}") for k in names])
    ranges = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "__range", *[
        F.coalesce(F.sum(f"__t_{k}").over(ranges), F.lit(0)).alias(f"__s_{k}") for k in names])
    cells = Window.partitionBy(*by, "__range").orderBy(*value, "__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.join(starts, [*by, "__range"]).select(*cell, *[
        (F.col(f"__s_{k}") + F.coalesce(F.sum(k).over(cells), F.lit(0))).alias(f"__o_{k}") for k in names])
    within = Window.partitionBy(*cell).orderBy("__key", *ids)
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.join(offsets, cell)
    added = {out: (F.col("__o_n") + F.row_number().over(within)).cast("bigint")}
    added |= {f"cum_{k}": F.col(f"__o_{k}") + F.sum(c).over(running) for k, c in sums.items()}
    return ranked.select("*", *[c.alias(k) for k, c in added.items()]).drop(
        "__key", "__p", *[f"__o_{k}" for k in names])


def shuffle_order(df: DataFrame, ids, seed=0, out: str = "position") -> DataFrame:
    """Seeded shuffle as an explicit position."""
    return ordinal_rank(df, [], None, ids, seed, out)
