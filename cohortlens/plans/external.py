"""Enrolment at other institutions: codes, types, spells to terms, quality."""

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.functions.nulls import flag
from cohortlens.functions.terms import season
from cohortlens.operators.aggs import max_low_missing, mean_of_known
from cohortlens.operators.joins import spells_to_terms
from cohortlens.operators.rows import clean_text_numbers


def placeholder_codes(colleges: DataFrame, code: str, keys) -> DataFrame:
    """Give colleges without a code a placeholder numbered over their distinct names (one row per college)."""
    missing = colleges.where(F.col(code).isNull()).select(*keys).distinct().withColumn(
        "__new", F.concat(F.lit("999999-"), F.dense_rank().over(Window.orderBy(*keys)).cast("string")))
    return colleges.join(missing, list(keys), "left").withColumn(code, F.coalesce(code, "__new")).drop("__new")


def external_terms(spells: DataFrame, sample: DataFrame, years: tuple[int, int]) -> DataFrame:
    """One row per student x college x term of outside enrolment in the observation window, within the calendar's years.

    ``sample``: student, first, earliest, last. Intensity is the highest known one; an unknown one ranks
    below every known value but is missing again when nothing better is found.
    """
    terms = spells_to_terms(spells, years).join(sample, "student").where(
        (F.col("strm") >= F.col("earliest")) & (F.col("strm") <= F.col("last")))
    return terms.groupBy("student", "college", "strm").agg(
        max_low_missing(F.col("intensity")).alias("intensity"), F.max(flag(F.col("strm") < F.col("first"))).alias("pre"))


def external_counts(terms: DataFrame) -> DataFrame:
    """Colleges and terms of outside enrolment before and after entry."""
    after = F.col("pre") == 0
    return terms.groupBy("student").agg(
        F.count_distinct(F.when(~after, F.col("college"))).alias("pre_num_coll"), F.count_distinct(F.when(after, F.col("college"))).alias("num_coll"),
        F.count_distinct(F.when(~after, F.col("strm"))).alias("pre_terms"), F.count_distinct(F.when(after, F.col("strm"))).alias("terms"))


def school_quality(raw: DataFrame, measures: dict) -> DataFrame:
    """College quality table from text: ``NULL`` markers cleared, and a measure's stand-in used where it is missing.

    ``measures``: output -> (column, stand-in column or None).
    """
    cols = [c for pair in measures.values() for c in pair if c]
    clean = clean_text_numbers(raw, {c: {"NULL": None} for c in cols})
    return clean.select("college", *[F.coalesce(*[F.col(c) for c in pair if c]).alias(n) for n, pair in measures.items()])


def external_quality(terms: DataFrame, sample: DataFrame, quality: DataFrame, types: DataFrame, measures, type_cols) -> DataFrame:
    """Intensity-weighted school quality and attended school types per student, after entry.

    Unknown intensity takes the training mean of its season (summer or not). ``sample``: student, valid.
    """
    rows = terms.where("pre = 0").join(sample.select("student", "valid"), "student")
    summer, training = season(F.col("strm")) == 3, F.col("valid") == 0
    means = rows.agg(F.struct(F.avg(F.when(training & ~summer, F.col("intensity"))).alias("main"),
                              F.avg(F.when(training & summer, F.col("intensity"))).alias("summer"))).scalar()
    mean = F.when(summer, F.col("__m")["summer"]).otherwise(F.col("__m")["main"])
    per = rows.withColumn("__m", means).withColumn("intensity", F.coalesce("intensity", mean)).groupBy("student", "college").agg(
        F.sum("intensity").alias("intensity"))
    joined = per.join(quality, "college", "left").join(types, "college", "left")
    return joined.groupBy("student").agg(
        *[mean_of_known(F.col(m), F.col("intensity")).alias(m) for m in measures], *[F.max(t).alias(t) for t in type_cols])
