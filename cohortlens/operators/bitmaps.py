"""Exact distinct counts from bitmaps that can be stored and merged.

A set of integer ids is kept as bitmaps of 32,768 neighbouring ids. Counts of several columns come from one shuffle of bitmaps,
and sets that are stored by part (a year, a source) give the counts of any union of parts without the rows. Meant for few
groups of many ids: a bitmap has 4 KB however few of its ids occur.
"""

from pyspark.sql import DataFrame, functions as F

from cohortlens.operators.aggs import _cols


def distinct_parts(df: DataFrame, by, ids) -> DataFrame:
    """(by..., variable, bucket, bits): the sets of the integer columns ``ids`` within each group; missing ids are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("bigint").alias("id")) for c in ids])).alias("__e")
    rows = df.select(*_cols(by), each).select(*_cols(by), "__e.*").where("id IS NOT NULL")
    bucket = F.bitmap_bucket_number("id").alias("bucket")
    return rows.groupBy(*_cols(by), "variable", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def merged_parts(parts: DataFrame, by=()) -> DataFrame:
    """The sets of coarser groups."""
    return parts.groupBy(*_cols(by), "variable", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(parts: DataFrame, by=()) -> DataFrame:
    """(by..., variable, n): distinct ids of each group, from the parts of finer ones."""
    return merged_parts(parts, by).groupBy(*_cols(by), "variable").agg(F.sum(F.bitmap_count("bits")).alias("n"))
