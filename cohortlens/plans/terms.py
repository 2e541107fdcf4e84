"""Term-level history features (one row per student x term)."""

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.functions import grades as g
from cohortlens.functions.grades import adjusted_credit, effective_credit, points
from cohortlens.functions.nulls import flag, in_list, ratio, zero
from cohortlens.functions.terms import possible_main_terms, season
from cohortlens.operators import windows as w
from cohortlens.operators.aggs import mean_of, total_if, with_group_values
from cohortlens.operators.rows import has_and_zero
from cohortlens.operators.joins import assemble


def age_at_term(age: str, observed: str, strm: str) -> Column:
    return (F.col(age) + F.floor((F.col(strm) - F.col(observed)) / 10)).cast("bigint")


def stop_out(terms: DataFrame) -> DataFrame:
    """Prior terms, and the share of possible fall and spring terms since entry not attended."""
    main = F.when(season(F.col("strm")) != 3, 1).otherwise(0)
    out = terms.withColumns({
        "first": F.min("strm").over(w.through("student")),
        "prior_terms": w.term_index("student") - 1,
        "attended": zero(F.sum(main).over(w.earlier("student"))),
    })
    possible = possible_main_terms(F.col("first"), F.col("strm"))
    return out.withColumn("pct_stopped", ratio(possible - F.col("attended"), possible))


def term_history(classes: DataFrame) -> DataFrame:
    """Prior terms, stop-out, prior shares of withdrawn / incomplete / developmental credit, prior completion."""
    c, grade, num = F.col("credit"), F.col("grade"), F.col("course_num")
    per = classes.groupBy("student", "strm").agg(
        F.sum(c).alias("all"), total_if(c, grade == "W").cast("double").alias("withdrawn"),
        total_if(c, grade.isin("I", "R")).cast("double").alias("incomplete"),
        total_if(c, g.is_short_number(num)).cast("double").alias("dev"),
        total_if(c, in_list(grade, g.EARNED)).cast("double").alias("earned"),
        total_if(c, ~in_list(grade, g.NOT_ATTEMPTED)).cast("double").alias("attempted"))
    per = stop_out(per.withColumn("prop_comp", ratio(F.col("earned"), F.col("attempted"))))
    return per.select(
        "student", "strm", "prior_terms", zero(F.col("pct_stopped")).alias("pct_stopped"),
        *[w.prior_share(x, "all", "student").alias(f"pct_{x}") for x in ("withdrawn", "incomplete", "dev")],
        w.prior_share("earned", "attempted", "student").alias("overall_prop_comp"),
        w.expanding_sd("prop_comp", "student").alias("prop_comp_sd"))


def term_gpa_intensity(classes: DataFrame) -> DataFrame:
    """Per student-term: adjusted credits attempted (x1.5 in summer) and GPA."""
    c, grade = F.col("credit"), F.col("grade")
    per = classes.groupBy("student", "strm").agg(
        F.sum(adjusted_credit(c, grade)).alias("credits"),
        mean_of(points(grade), effective_credit(c, grade, g.COUNTED)).alias("term_gpa"))
    return per.withColumn("credits", F.when(season(F.col("strm")) == 3, F.col("credits") * 1.5).otherwise(F.col("credits")))


def gpa_intensity_lags(per: DataFrame) -> DataFrame:
    """Current intensity, previous intensity, GPA of the last two enrolled terms, with availability flags."""
    lagged = per.select("student", "strm", F.col("credits").alias("crnt_enrl_intensity"),
                        w.lag_term("credits", 1, "student").alias("enrl_intensity"),
                        w.lag_term("term_gpa", 1, "student").alias("term_gpa_1"),
                        w.lag_term("term_gpa", 2, "student").alias("term_gpa_2"))
    return has_and_zero(lagged, ["enrl_intensity", "term_gpa_1", "term_gpa_2"])


def trends(per: DataFrame) -> DataFrame:
    gpa = w.best_suffix_trend(per, "student", "strm", "term_gpa", "gpa_trend")
    return w.best_suffix_trend(gpa, "student", "strm", "credits", "intensity_trend").select(
        "student", "strm", "gpa_trend", "intensity_trend")


def dual_enrolment(snaps: DataFrame, terms: DataFrame) -> DataFrame:
    """Dual enrolment in the term and in any earlier term, for the given student-terms."""
    dual = snaps.groupBy("student", "strm").agg(F.max("dual_enrollment").alias("dual"))
    both = dual.join(terms, ["student", "strm"], "full_outer").withColumn("dual_ind", zero(F.col("dual")))
    return both.select("student", "strm", "dual_ind", zero(w.ever("dual_ind", "student", inclusive=False)).alias("ever_dual")).join(
        terms, ["student", "strm"], "left_semi")


def prior_cumulative_gpa(classes: DataFrame, known: DataFrame) -> DataFrame:
    """Cumulative GPA at the start of each term: the recorded value, or after the first term the one
    recomputed from earlier courses (last term with a value)."""
    w2 = effective_credit(F.col("credit"), F.col("grade"), g.COUNTED)
    per = classes.groupBy("student", "strm").agg(F.sum(w2).alias("w"), F.sum(w2 * points(F.col("grade"))).alias("wp"))
    so_far = w.running_ratio("wp", "w", "student")
    per = per.withColumn("so_far", so_far)
    per = per.withColumn("prior", F.last("so_far", ignorenulls=True).over(w.earlier("student")))
    joined = per.join(known.select("student", "strm", "cum_gpa"), ["student", "strm"], "left")
    return joined.select("student", "strm", F.coalesce("cum_gpa", "prior").alias("cum_gpa"))


def term_predictors(terms: DataFrame, blocks, imputed, fit_before: int) -> DataFrame:
    """Term-level blocks joined; first-term rows get zeros, later rows the training mean."""
    wide = with_group_values(assemble(terms, blocks, ["student", "strm"], "inner"), "student", __first=F.min("strm"))
    first = F.col("strm") == F.col("__first")
    wide = wide.withColumn("first_ind", flag(first)).drop("__first")
    fitted = wide.where((F.col("first_ind") == 0) & (F.col("strm") < fit_before))
    means = fitted.agg(F.struct(*[F.avg(c).alias(c) for c in imputed])).scalar()
    keys = ("student", "strm", "first_ind")
    fill = {c: F.coalesce(F.col(c), F.when(F.col("first_ind") == 1, F.lit(0)).otherwise(
        F.col("__mean")[c] if c in imputed else F.lit(None))) for c in wide.columns if c not in keys}
    return wide.withColumn("__mean", means).withColumns(fill).drop("__mean")
