"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources in order of code points (a missing one last) get weights 1, 2, 3, repeating, and share all words by them; no
source gets more than ``MOST`` times its own words, and what is over goes to the others by weight until none is above. Sorted
by words per weight, the capped sources are the first ones, so one pass of running sums finds them.

Selection: a source gives as many whole epochs as its target holds; the rest of the target is filled from documents in
ascending order of ``-ln(u) / quality``, u being uniform and taken from a digest of the document's id: a weighted sample
without replacement. A document is taken if more than half of it lies below the budget in the running sum of sizes, so the sum
ends within half a document of the target. No randomness depends on partitions or runs.

Running sums over a source that holds any share of the rows: keys are cut into ranges at approximate quantiles of the keys
themselves, so that no range is much larger than another whatever the qualities are, one for about ``ROWS`` rows; totals for each
(source, range) give what stands before a range, and only inside a range are rows ordered. The tables of sources and of ranges
are small against the rows; rows are shuffled once.

Defined cases: a missing or blank text has size 0 and is never taken in the rest; a source of empty texts has target 0; ties
of the key are ordered by id, then by ``tie`` (a hash of the text), then by size, so only rows that agree in all of these are
interchangeable; rows without an id have keys of their own from ``tie``; columns of the input named ``source_size``, ``target`` or
``epochs`` are replaced, others stay; an empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm.common import WORD_CLASS, fresh, stored
from cohortlens.operators.ranking import edges_below

MOST, SEED = 3, 7
#: Rows of a range, about, and ranges at most.
ROWS, RANGES = 50_000, 1 << 11
#: Symbols and digits that speak against a text.
MARKS = "0123456789#*$%&|<>!=_@\\^~"


def words(text: str = "text") -> Column:
    """Words of a text; none in a missing one."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_CLASS + "+")), F.lit(0)).cast("long")


def quality(text: str = "text") -> Column:
    """A weight from 0.1 to 1: the share of characters that are no symbols or digits."""
    kept = F.length(F.translate(F.col(text), MARKS, "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.1), F.coalesce(kept, F.lit(0.1)))


def tie(text: str = "text") -> Column:
    """Tells rows apart that have the same id or none."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size) with ``target``; a row for each source."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    # In order of size per weight: what is left and who shares it if all before a source are capped.
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    steps = weighed.select(
        "*",
        ((F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
         / F.sum("weight").over(rest)).alias("level"))
    # The level at the first source that stays below its cap holds for all after it.
    free = F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.col("level"))
    steps = steps.withColumn("final", F.first(free, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
    return steps.select("source", "source_size", F.coalesce(
        F.least(F.col("final") * F.col("weight"), (most * F.col("source_size")).cast("double")),
        (most * F.col("source_size")).cast("double")).alias("target"))


def sample(sized: DataFrame, most: int = MOST, seed: int = SEED, doc_id: str = "doc_id", tie: str = "tie") -> DataFrame:
    """``sized`` (an id, source, size, quality and, if ids may be missing or repeated, ``tie``; stored) with source_size, target
    and ``epochs``: how often a document is taken."""
    sized = sized.drop("source_size", "target", "epochs")
    key, place, upto_, s, r = fresh(sized, "key_", "range_", "upto_", "s_", "r_")
    apart = F.col(tie) if tie in sized.columns else F.lit(0).cast("long")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("#"), apart.cast("string")))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    keyed = sized.withColumn(key, -F.log(u) / F.col("quality"))
    n = 1 << min(RANGES, max(8, sized.count() // ROWS)).bit_length()
    cuts = keyed.agg(F.percentile_approx(key, [k / n for k in range(1, n)], max(10_000, 4 * n)).alias("c")).first()["c"] or []
    # As many as a power of two less one, which the binary search takes; an empty table needs none.
    edges = F.array(*[F.lit(c) for c in cuts]) if cuts else None
    keyed = keyed.withColumn(place, F.lit(0) if edges is None else edges_below(F.col(key), edges, len(cuts)))
    ranges = stored(keyed.groupBy("source", place).agg(F.sum("size").alias("n")), "ranges")
    plan = targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), most)
    before = ranges.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy(place)) - F.col("n")).drop("n")
    limits = stored(before.join(plan, before["source"].eqNullSafe(plan["source"])).select(
        before["source"].alias(s), F.col(place).alias(r), F.col("before").alias(upto_), "source_size", "target"), "limits")
    rows = keyed.join(limits, keyed["source"].eqNullSafe(F.col(s)) & (F.col(place) == F.col(r)))
    inside = Window.partitionBy("source", place).orderBy(key, doc_id, apart, "size")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col(upto_)
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    budget = F.col("target") - whole * F.col("source_size")
    rows = rows.withColumn(upto_, upto)
    taken = (F.col("size") > 0) & (2 * (F.col(upto_) - F.col("size")) + F.col("size") < 2 * budget)
    return rows.withColumn("epochs", (whole + taken.cast("int")).cast("int")).drop(key, place, upto_, s, r)
