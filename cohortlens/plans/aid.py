"""Financial aid by term and year."""

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.nulls import flag, ratio, zero
from cohortlens.functions.terms import term_code
from cohortlens.operators import windows as w
from cohortlens.operators.aggs import total
from cohortlens.operators.joins import skeleton
from cohortlens.operators.reshape import lengthen, year_buckets


def credit_shares(aid: DataFrame, terms=("sum", "fal", "spr")) -> DataFrame:
    """Share of the year's credits per term. Terms with aid but no credits at all count one credit each,
    terms without aid count none."""
    for t in terms:
        if f"aid{t}" not in aid.columns:
            aid = aid.withColumn(f"aid{t}", flag(F.col(f"cred{t}") > 0))
    total_now = lambda: sum((zero(F.col(f"cred{t}")) for t in terms), F.lit(0))
    fill = lambda df: df.withColumn("__all", total_now()).withColumns({
        f"cred{t}": F.when((F.col("__all") == 0) & (F.col(f"aid{t}") == 1), 1).otherwise(F.col(f"cred{t}")) for t in terms})
    aid = fill(aid)
    aid = aid.withColumns({f"cred{t}": F.when(F.col(f"aid{t}") == 0, 0).otherwise(F.col(f"cred{t}")) for t in terms})
    aid = fill(aid).withColumn("__all", total_now())
    return aid.withColumns({f"pct{t}": ratio(F.col(f"cred{t}"), F.col("__all")) for t in terms}).drop(
        "__all", *[f"{p}{t}" for p in ("cred", "aid") for t in terms])


def allocate_terms(aid: DataFrame, amounts=("pell", "grants")) -> DataFrame:
    """Yearly amounts split over summer, fall and spring by credit share; spring belongs to the next year."""
    shares = credit_shares(aid)
    parts = {3: "sum", 4: "fal", 2: "spr"}
    wide = shares.withColumns({f"{a}_{t}": F.col(a) * F.col(f"pct{name}") for a in amounts for t, name in parts.items()})
    long = lengthen(wide, ["student", "year", "budget"], {a: {t: f"{a}_{t}" for t in parts} for a in amounts}, "term")
    year = F.col("year") + F.when(F.col("term") == 2, 1).otherwise(0)
    return long.select("student", term_code(year, F.col("term")).alias("strm"), "budget", *amounts)


def term_aid(aid: DataFrame, amounts=("grants",)) -> DataFrame:
    """Per student-term: a Pell flag that is unknown when the budget is and no Pell was paid, and amounts."""
    terms = allocate_terms(aid, ("pell", *amounts))
    hidden = F.when(F.col("budget").isNull() & (F.col("pell") == 0), None).otherwise(F.col("pell"))
    per = terms.withColumn("pell", hidden).groupBy("student", "strm", "budget").agg(
        total("pell").alias("pell"), *[F.sum(a).alias(a) for a in amounts])
    unknown = F.col("budget").isNull() & (F.col("pell") == 0)
    per = per.withColumn("pell", F.when(~unknown, flag(F.col("pell") > 0)))
    return per.groupBy("student", "strm").agg(F.max("pell").alias("pell"), *[F.sum(a).alias(a) for a in amounts])


def aid_record(aid: DataFrame, first_terms: DataFrame, last_terms, amounts=("grants",)) -> DataFrame:
    """Term aid within the observation window plus the student's amounts per year since entry.

    ``first_terms``: student, first; ``last_terms``: expression of the last term of the window.
    """
    inside = term_aid(aid, amounts).join(first_terms, "student").where(
        (F.col("strm") >= F.col("first")) & (F.col("strm") <= last_terms))
    years = year_buckets(inside, "student", "first", "strm", amounts)
    return inside.select("student", "strm", "pell").join(years, "student")


def pell_status(students: DataFrame, terms, term_pell: DataFrame) -> DataFrame:
    """For every student and calendar term: Pell ever received up to the term, and in the term."""
    grid = skeleton(students, terms).join(term_pell.select("student", "strm", "pell"), ["student", "strm"], "left")
    out = grid.withColumn("__ever", w.ever("pell", "student"))
    return out.select("student", "strm", flag(F.col("__ever") == 0).alias("pell_ever_0"), flag(F.col("__ever") == 1).alias("pell_ever_1"),
                      flag(F.col("pell") == 0).alias("pell_target_0"), flag(F.col("pell") == 1).alias("pell_target_1"))
