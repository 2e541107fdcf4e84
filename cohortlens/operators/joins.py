"""Joins with match indicators, cardinality contracts and history look-ups.

No side is ever hinted for broadcast: Catalyst and adaptive execution choose by size, and split
skewed shuffle partitions.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.nulls import is_true
from cohortlens.sources.contracts import assert_no_nulls, assert_unique, write_checked
from cohortlens.sources.shuffles import deal


def join(left: DataFrame, right: DataFrame, on, how: str = "inner", expect: str | None = None) -> DataFrame:
    """Equi-join; ``expect`` ('1:1', 'm:1', '1:m') checks the side that must be unique first."""
    if expect:
        many_left, many_right = expect.split(":")
        if many_left == "1":
            assert_unique(left, on)
        if many_right == "1":
            assert_unique(right, on)
    return left.join(right, on, how)


def merge_indicator(left: DataFrame, right: DataFrame, on, out: str = "merge_code") -> DataFrame:
    """Full outer join; code 1 left only, 2 right only, 3 both."""
    l, r = left.withColumn("__l", F.lit(1)), right.withColumn("__r", F.lit(1))
    code = F.when(F.col("__r").isNull(), 1).when(F.col("__l").isNull(), 2).otherwise(3)
    return l.join(r, on, "full_outer").withColumn(out, code).drop("__l", "__r")


def restrict(df: DataFrame, ids: DataFrame, on) -> DataFrame:
    return df.join(ids, on, "left_semi")


def exclude(df: DataFrame, ids: DataFrame, on) -> DataFrame:
    return df.join(ids, on, "left_anti")


def exclude_inconsistent(left: DataFrame, right: DataFrame, entity: str, on) -> DataFrame:
    """Left rows of entities that have no right-only row."""
    offenders = right.join(left.select(*on), list(on), "left_anti").select(entity).distinct()
    return left.join(offenders, entity, "left_anti")


def lookup_fallback(df: DataFrame, fine: DataFrame, fine_on, coarse: DataFrame, coarse_on, value: str, fallback: str,
                    out: str) -> DataFrame:
    """Fine-grained value, else the coarse one."""
    joined = df.join(fine, list(fine_on), "left").join(coarse, list(coarse_on), "left")
    return joined.withColumn(out, F.coalesce(value, fallback)).drop(value, fallback)


def spells_to_terms(spells: DataFrame, years: tuple[int, int], begin: str = "begin_date", end: str = "end_date",
                    out: str = "strm") -> DataFrame:
    """One row per spell x overlapped term of the calendar, ``years`` being its first and last year; a spell with an end
    far in the future gives no terms beyond.

    A spell reaches only a handful of terms, so the terms are generated from its own dates and no
    range join is needed: spring is months 1-4, summer 6-7, fall 9-12.
    """
    since, until = F.greatest(F.year(begin), F.lit(years[0])), F.least(F.year(end), F.lit(years[1]))
    span = F.explode(F.when(since <= until, F.sequence(since, until))).alias("__year")
    windows = F.array(*[
        F.struct(F.lit(t).alias("t"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
        for t, lo, hi in ((2, 1, 4), (3, 6, 7), (4, 9, 12))
    ])
    by, bm, ey, em = F.year(begin), F.month(begin), F.year(end), F.month(end)
    year, w = F.col("__year"), F.col("__w")
    starts = (by < year) | ((by == year) & (bm <= w["hi"]))
    ends = (ey > year) | ((ey == year) & (em >= w["lo"]))
    return (
        spells.select("*", span)
        .select("*", F.explode(windows).alias("__w"))
        .where(starts & ends)
        .withColumn(out, (10 * (year - 1800) + w["t"]).cast("int"))
        .drop("__year", "__w")
    )


def totals_before(target: DataFrame, history: DataFrame, keys, time: str, sums: dict) -> DataFrame:
    """For each (keys, time) of ``target``, totals of ``history`` rows of the same keys with an earlier time.

    Both sides are stacked and summed per (keys, time), then one window over the few distinct times of each
    key adds up what came before: no pairs of rows are formed. ``sums`` maps output names to columns of
    ``history``; a missing output means there was no earlier row.
    """
    keys = list(keys)
    past = history.select(*keys, time, *[F.col(c).cast("double").alias(n) for n, c in sums.items()],
                          F.lit(1).alias("__rows"), F.lit(0).alias("__wanted"))
    asked = target.select(*keys, time, *[F.lit(None).cast("double").alias(n) for n in sums],
                          F.lit(None).cast("int").alias("__rows"), F.lit(1).alias("__wanted"))
    grid = past.unionByName(asked).groupBy(*keys, time).agg(
        *[F.sum(n).alias(n) for n in sums], F.sum("__rows").alias("__rows"), F.max("__wanted").alias("__wanted"))
    before = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    totals = grid.select(*keys, time, "__wanted", *[F.sum(n).over(before).alias(n) for n in sums],
                         F.sum("__rows").over(before).alias("rows_before")).where("__wanted = 1").drop("__wanted")
    return target.join(totals, [*keys, time], "left")


def own_totals_before(history: DataFrame, keys, time: str, sums: dict) -> DataFrame:
    """As :func:`totals_before` where every (keys, time) of the history is itself a target; no join back."""
    keys = list(keys)
    per = history.groupBy(*keys, time).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, time, *[F.sum(n).over(before).alias(n) for n in sums])


def skeleton(ids: DataFrame, terms: Column) -> DataFrame:
    """Every id with every term; ``terms`` is a calendar array, so each id yields its own rows."""
    return ids.select("*", F.explode(terms).alias("strm"))


def assemble(base: DataFrame, blocks, on, how: str = "left", complete: bool = False) -> DataFrame:
    """Chain of joins of feature blocks that share one key, shuffled once on it. ``complete`` raises an error if any
    value of the assembled table is missing."""
    wide = reduce(lambda acc, block: acc.join(block, on, how), blocks, base)
    return assert_no_nulls(wide) if complete else wide


def assemble_checked(base: DataFrame, blocks: dict, path: str, unique, required: bool = True, complete: bool = True,
                     dealt_by: str | None = None) -> tuple[DataFrame, dict]:
    """Join feature blocks to ``base``, write the table and check what was written.

    ``blocks``: name -> (block, key columns). With ``required`` rows that a block lacks are left out; the report counts them as
    ``without <name>``. The result must have one row per ``unique`` key (a block with a repeated key shows there) and, with
    ``complete``, no missing value. See ``write_checked`` for what is raised. Blocks in buckets of ``dealt_by`` cost no exchange: other
    blocks are joined first, then the rows are dealt once. The columns are in the order of ``blocks`` all the same.
    """
    wide, marks = base, []
    kept = base.columns
    for block, on in blocks.values():
        kept = [*on, *[c for c in kept if c not in on], *[c for c in block.columns if c not in on]]
    inside = lambda item: dealt_by in item[1][1]
    for k, (name, (block, on)) in enumerate(ordered := sorted(blocks.items(), key=inside)):
        if k and inside(ordered[k]) and not inside(ordered[k - 1]):
            wide = deal(wide, dealt_by)
        mark = f"__has_{name}"
        marks.append(mark)
        wide = wide.join(block.withColumn(mark, F.lit(True)), list(on), "left")
    whole = reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in marks], F.lit(True))
    missing = {f"without {m[6:]}": F.col(m).isNull() for m in marks}
    return write_checked(wide.select(*kept, *marks), path, unique, kept if complete else (), missing, drop=marks, only=is_true(whole) if required else None)


def assemble_scores(tables: dict, key: str = "id", score: str = "score") -> DataFrame:
    """Variant score tables as columns ``pred_<name>`` of one row per key."""
    named = [t.select(key, F.col(score).alias(f"pred_{n}")) for n, t in tables.items()]
    return reduce(lambda a, b: a.join(b, key, "left"), named)
