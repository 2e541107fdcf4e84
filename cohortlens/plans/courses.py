"""Course-level history features (one row per student x term x course section)."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.codes import CLUSTERS, seeded_key, subject_cluster
from cohortlens.functions.grades import (adjusted_credit, clean_course_number, course_points, credit_if,
                                         graded_credit, is_college_level)
from cohortlens.functions import grades as g
from cohortlens.functions.nulls import flag, in_list, is_true, ratio, zero
from cohortlens.operators import windows as w
from cohortlens.operators.aggs import pick, share_of, total_if, with_group_values, mode_by
from cohortlens.operators.joins import assemble, assemble_checked, lookup_fallback, own_totals_before, totals_before
from cohortlens.operators.levels import encode_levels, fit_levels
from cohortlens.operators.rows import one_hot
from cohortlens.sources.buckets import bucketed
from cohortlens.sources.scan import sink
from cohortlens.sources.shuffles import deal


def with_course(df: DataFrame) -> DataFrame:
    return df.withColumn("course", F.concat_ws("_", "subject", "course_num"))


def graded(df: DataFrame) -> DataFrame:
    """Adds the graded credit ``w``, the grade points ``pts`` and their product ``wp``."""
    return df.withColumns({"w": graded_credit(F.col("credit"), F.col("grade")),
                           "pts": course_points(F.col("grade"))}).withColumn("wp", F.col("w") * F.col("pts"))


def trailing_grades(graded_rows: DataFrame, terms: Column) -> tuple[DataFrame, DataFrame]:
    """Credit-weighted average grade over the five years before each term, by course and by college.

    Both start from the same sums per college x course x term, so they share that shuffle.
    """
    per = graded_rows.where("w > 0").groupBy("college", "course", "strm").agg(F.sum("wp").alias("wp"), F.sum("w").alias("w"))
    fine = w.trailing_mean(per, ["college", "course"], terms, "wp", "w")
    coarse = w.trailing_mean(per, "college", terms, "wp", "w")
    return fine, coarse.withColumnRenamed("avg_grade", "avg_grade_2")


def fill_grades(df: DataFrame, dealt: bool = False) -> DataFrame:
    """A missing grade takes the only known grade of the same course taken by the student in the term,
    first within the college, then across colleges; lone rows without credit and grade are dropped.

    The empty grade is a missing one; where nothing fills it, it stays as it came. Rows are dealt by student once: both rules
    are windows within a student's course of a term, and what groups by student afterwards finds them in place. ``dealt``: the rows
    are in buckets of the student already.
    """
    df = df.withColumn("course_num", clean_course_number(F.col("course_num")))
    wide = ["student", "strm", "subject", "course_num"]
    known = F.nullif(F.col("grade"), F.lit(""))
    course, anywhere = Window.partitionBy(*wide, "college"), Window.partitionBy(*wide)
    rows = (df if dealt else deal(df, "student")).withColumn("__known", known)
    rows = rows.withColumns({"__lo": F.min("__known").over(course), "__hi": F.max("__known").over(course), "__n": F.count(F.lit(1)).over(course)})
    # Filling within a college adds no new grade to the course, so the second rule reads the grades as they came.
    rows = rows.withColumns({"__wlo": F.min("__known").over(anywhere), "__whi": F.max("__known").over(anywhere)})
    only = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo"))
    elsewhere = F.when(F.col("__wlo") == F.col("__whi"), F.col("__wlo"))
    mark = F.coalesce("__known", only)
    rows = rows.where(~((F.col("credit") == 0) & (F.col("__n") == 1) & mark.isNull()))
    return rows.withColumn("grade", F.coalesce(mark, elsewhere, "grade")).select(*df.columns)


def aggregate_courses(df: DataFrame, seed=1234) -> DataFrame:
    """One row per student x term x course: credits, estimated grade, chosen college."""
    keys = ["student", "strm", "subject", "course_num"]
    grade, credit = F.col("grade"), F.col("credit")
    numeric = is_true(F.col("course_num").rlike("^([0-9]{3}|[0-9]{3}L|[0-9]{4}L)$"))
    level = is_college_level(F.col("course_num"))
    rows = df.withColumns({
        "eff": graded_credit(credit, grade), "pts": course_points(grade),
        "eff2": credit_if(credit, numeric & in_list(grade, g.COUNTED)),
        "adj": adjusted_credit(credit, grade), "new": F.when(in_list(grade, ["W", "X", "XN", "XY"]), 0.0).otherwise(credit),
    })
    order = F.struct(-credit, -F.col("pts"), seeded_key(seed, F.col("student"), F.col("strm"), F.col("subject"),
                                                       F.col("course_num"), F.col("college"), F.col("section")))
    return rows.groupBy(*keys).agg(
        F.min_by("college", order).alias("college"),
        ratio(F.sum(F.col("eff") * F.col("pts")), F.sum("eff")).alias("est_grade"),
        F.sum("new").alias("credit"), F.sum("adj").alias("adj_credit"),
        F.sum("eff2").alias("gpa_credit"), F.sum(F.col("eff2") * F.col("pts")).alias("gpa_points"),
        F.min(flag(grade == "W")).alias("withdrawn"),
        total_if(credit, level).cast("double").alias("level_attempted"),
        total_if(credit, level & ~in_list(grade, g.NOT_PASSED)).cast("double").alias("level_earned"))


def with_cumulative_credits(courses: DataFrame) -> DataFrame:
    """Adds the term's attempted credit and the college-level credit earned before the term (as earned, and
    with the last term counted as attempted). ``courses`` has one row per student x term x course, so a
    student's partition is bounded by calendar and catalogue."""
    student = Window.partitionBy("student").orderBy("strm")
    before = student.rangeBetween(Window.unboundedPreceding, -1)
    term = student.rangeBetween(0, 0)
    rows = courses.withColumns({
        "term_credits_attempted": F.sum("adj_credit").over(term),
        "__gap": F.sum(F.col("level_attempted") - F.col("level_earned")).over(term),
        "cum_earned": zero(F.sum("level_earned").over(before)),
    })
    last_gap = zero(F.last("__gap").over(before))
    return rows.withColumn("cum_expected", F.col("cum_earned") + last_gap).drop("__gap", "level_attempted", "level_earned")


def prior_grades(target: DataFrame, history: DataFrame, prereqs: DataFrame) -> DataFrame:
    """Credit-weighted grade over earlier terms in any prerequisite of the target course, and over earlier
    attempts of the course itself.

    Each target row is spread over the courses it asks about and looks up the running totals of that
    (student, course), so no history pairs are formed.
    """
    keys = target.columns
    own = target.select(*keys, F.col("course").alias("__asked"), F.lit(1).alias("__own"))
    needed = target.join(prereqs, "course").select(*keys, F.col("prereq").alias("__asked"), F.lit(0).alias("__own"))
    asked = own.unionByName(needed).withColumnsRenamed({"course": "__course", "__asked": "course"})
    found = totals_before(asked, history, ["student", "course"], "strm", {"__w": "w", "__wp": "wp"})
    mean = lambda own_: ratio(F.sum(F.when(F.col("__own") == own_, F.col("__wp"))), F.sum(F.when(F.col("__own") == own_, F.col("__w"))))
    by = [F.col("__course").alias("course") if k == "course" else F.col(k) for k in keys]
    return found.groupBy(*by).agg(mean(0).alias("__p"), mean(1).alias("__r")).select(
        *keys, flag(F.col("__p").isNotNull()).alias("has_prereq_grade"), zero(F.col("__p")).alias("prereq_grade"),
        flag(F.col("__r").isNotNull()).alias("has_repeat_grade"), zero(F.col("__r")).alias("repeat_grade"))


def repeat_grades(target: DataFrame, history: DataFrame) -> DataFrame:
    """Credit-weighted grade over earlier attempts of the same course."""
    found = totals_before(target, history, ["student", "course"], "strm", {"__w": "w", "__wp": "wp"})
    return found.select(*target.columns, flag(F.col("__w").isNotNull()).alias("has_repeat_grade"),
                        zero(ratio(F.col("__wp"), F.col("__w"))).alias("repeat_grade"))


def concurrent_difficulty(df: DataFrame, terms: Column) -> DataFrame:
    """Credit-weighted average grade of the other courses taken in the same term; ``df`` has one row per
    student x term x college x course with a credit."""
    fine, coarse = trailing_grades(graded(df), terms)
    base = df.where("credit > 0").groupBy("student", "strm", "college", "course").agg(F.sum("credit").alias("credit"))
    avg = lookup_fallback(base, fine, ["strm", "college", "course"], coarse, ["strm", "college"],
                          "avg_grade", "avg_grade_2", "avg_g")
    out = w.leave_one_out(avg.withColumn("avg_g", zero(F.col("avg_g"))), ["student", "strm"], "avg_g", "credit", "avg_g_concurrent")
    return out.select("student", "strm", "college", "course",
                      flag(F.col("avg_g_concurrent").isNotNull()).alias("has_avg_g_concurrent"),
                      zero(F.col("avg_g_concurrent")).alias("avg_g_concurrent"))


def cluster_history(target: DataFrame, history: DataFrame) -> DataFrame:
    """Pair features ``{source}_{target}`` and ``{source}_{target}_grade``: earlier grades by source cluster,
    placed under the target row's own cluster and 0 elsewhere."""
    found = cluster_totals(target, history)
    return found.select(*target.columns, *pair_columns())


def pair_columns() -> list[Column]:
    """The pair features of :func:`cluster_history`, from the columns of :func:`cluster_totals`."""
    out = {}
    for c in CLUSTERS:
        for t in CLUSTERS:
            mine = F.col("cluster") == t
            out[f"{c}_{t}"] = F.when(mine, F.col(c)).otherwise(0)
            out[f"{c}_{t}_grade"] = F.when(mine, F.col(f"{c}_grade")).otherwise(F.lit(0.0))
    return [v.alias(k) for k, v in out.items()]


def section_size(df: DataFrame) -> DataFrame:
    """Rows with the number of students of their section."""
    return with_group_values(df, ["strm", "college", "subject", "course_num", "section"], size=F.count(F.lit(1)))


SECTION = ["student", "strm", "college", "course", "section"]


def eligible_enrolments(df: DataFrame) -> DataFrame:
    """Rows with credit and a usable grade, credit summed to one row per student and section."""
    grade = F.when(F.col("grade") == "(D)", "D").when(F.col("grade") == "WC", "W").otherwise(F.col("grade"))
    rows = with_course(df).select(*SECTION, "credit", grade.alias("grade")).distinct().where("credit <> 0")
    usable = ~in_list(F.col("grade"), ["", "I", "P", "R", "S", "U", "X", "XY", "XN"])
    return rows.where(usable).groupBy(*SECTION).agg(F.min("grade").alias("grade"), F.sum("credit").alias("credit"))


def section_predictors(df: DataFrame, dealt: bool = False) -> DataFrame:
    """Section size, evening, online and second-year flags of college-level sections. ``dealt``: ``df`` is in buckets of the student,
    and the rows go back there after they met by section."""
    rows = fill_grades(df, dealt).where("credit <> 0").where(is_college_level(F.col("course_num")))
    keys = ["student", "college", "strm", "subject", "course_num", "section"]
    rows = section_size(rows.groupBy(*keys).agg(F.max("day_eve_code").alias("code")))
    return with_course(deal(rows, "student") if dealt else rows).select(
        *SECTION, "size", flag(F.col("code") == "E").alias("eve_ind"), flag(F.col("code") == "O").alias("online_ind"),
        flag(F.substring("course_num", 1, 1) == "2").alias("lvl2_ind"))


def course_records(df: DataFrame) -> DataFrame:
    """Grade-filled, aggregated courses with the credits earned before the term."""
    return with_course(with_cumulative_credits(aggregate_courses(fill_grades(df))))


def instructor_table(sections: DataFrame, tenure_after: int = 60) -> tuple[DataFrame, DataFrame]:
    """(full-time flag per section, tenure per instructor x college x term).

    ``sections``: strm, college, course, section, faculty_code, instructor. The lowest faculty code
    stands for a section taught by several; tenure counts from the first term at the college.
    """
    keys = ["strm", "college", "course", "section"]
    one = pick(sections.select(*keys, "faculty_code", "instructor"), keys, [F.col("faculty_code"), F.col("instructor")])
    full_time = one.select(*keys, flag(F.col("faculty_code") == 1).alias("full_time"))
    first = sections.groupBy("instructor", "college").agg(F.min("strm").alias("first_strm"))
    teaching = one.where("instructor is not null").select("instructor", *keys)
    tenure = teaching.join(first, ["instructor", "college"]).select(
        "instructor", *keys, flag(F.col("strm") - F.col("first_strm") >= tenure_after).alias("tenure"))
    return full_time, tenure


def past_average_grade(df: DataFrame, sections: DataFrame, dealt: bool = False) -> DataFrame:
    """For each instructor x college x course x term: mean class average of the sections taught earlier.

    ``sections``: instructor, college, course, strm, section. ``dealt`` as for :func:`fill_grades`.
    """
    seats = with_course(graded(fill_grades(df, dealt))).groupBy("student", "strm", "course", "college").agg(
        F.sum("w").alias("w"), F.sum("wp").alias("wp"))
    colleges = Window.partitionBy("student", "strm", "course")
    est = ratio(F.sum("wp").over(colleges), F.sum("w").over(colleges))
    classes = seats.select("strm", "college", "course", est.alias("est")).groupBy("strm", "college", "course").agg(
        F.avg("est").alias("avg_grade"))
    keys = ["instructor", "college", "course"]
    taught = sections.select(*keys, "strm", "section").distinct()
    valued = taught.join(classes, ["strm", "college", "course"], "left").withColumn("known", flag(F.col("avg_grade").isNotNull()))
    before = own_totals_before(valued, keys, "strm", {"s": "avg_grade", "k": "known"})
    past = ratio(F.col("s"), F.col("k"))
    return before.select(*keys, "strm", flag(past.isNotNull()).alias("has_past_avg_grade"), zero(past).alias("past_avg_grade"))


def cluster_totals(target: DataFrame, history: DataFrame) -> DataFrame:
    """For every target row: own cluster, and earlier grade in each source cluster (0 with flag 0 if none).

    One window over the terms of a student carries the running totals of all source clusters.
    """
    sums = {}
    src = history.withColumn("cluster", subject_cluster(F.col("subject")))
    for c in CLUSTERS:
        sums |= {f"__w_{c}": F.when(F.col("cluster") == c, F.col("w")), f"__p_{c}": F.when(F.col("cluster") == c, F.col("wp"))}
    found = totals_before(target, src.withColumns(sums), ["student"], "strm", {n: n for n in sums})
    out = {}
    for c in CLUSTERS:
        grade = ratio(F.col(f"__p_{c}"), F.col(f"__w_{c}"))
        out |= {f"{c}": flag(grade.isNotNull()), f"{c}_grade": zero(grade)}
    return found.select(*target.columns, subject_cluster(F.col("subject")).alias("cluster"), *[v.alias(k) for k, v in out.items()])


def term_shares(df: DataFrame) -> DataFrame:
    """Developmental flag and credit shares of second-year, evening and online courses per student-term."""
    keys = ["student", "strm", "college", "subject", "course_num"]
    rows = df.where("credit <> 0").select(*keys, "credit", "day_eve_code").distinct()
    code = mode_by(rows, keys, "day_eve_code", "max")
    lvl2 = (F.length("course_num") == 3) & (F.substring("course_num", 1, 1) == "2")
    per = rows.groupBy(*keys).agg(F.sum("credit").alias("credit")).join(code, keys)
    c = F.col("credit")
    return per.groupBy("student", "strm").agg(
        F.max(flag(F.length("course_num") < 3)).alias("dev"), share_of(c, lvl2).alias("lvl2_share"),
        share_of(c, F.col("day_eve_code") == "E").alias("eve_share"), share_of(c, F.col("day_eve_code") == "O").alias("online_share"))


def training_rows(eligible: DataFrame, blocks, colleges, baseline: str, valid_from: int) -> DataFrame:
    """Course-level training table: outcome, feature blocks, one-hot college, time split."""
    base = eligible.select(*SECTION, flag(F.col("grade").isin(g.PASSED_WELL)).alias("passed"))
    wide = one_hot(assemble(base, blocks, SECTION, "inner"), "college", colleges, baseline)
    return wide.withColumn("valid", flag(F.col("strm") >= valid_from))


def instructor_block(sections: DataFrame, past: DataFrame) -> DataFrame:
    """Per section: full-time flag, tenure and the past average grade of its instructor (0 and a flag without one).

    ``sections`` as in :func:`instructor_table`; ``past`` from :func:`past_average_grade`.
    """
    full_time, tenure = instructor_table(sections)
    keys = ["strm", "college", "course", "section"]
    rows = tenure.join(full_time, keys).join(past, ["instructor", "college", "course", "strm"], "left")
    return rows.select(*keys, "full_time", "tenure", zero(F.col("has_past_avg_grade")).alias("has_past_avg_grade"),
                       zero(F.col("past_avg_grade")).alias("past_avg_grade"))


def training_table(eligible: DataFrame, blocks: dict, colleges, baselines: dict, valid_from: int, folder: str, least_share: float = 0.0,
                   unseen: str = "zero") -> tuple[DataFrame, DataFrame, dict]:
    """The training and validation rows with all predictors: (table, level dictionary, report of the assembly).

    ``blocks``: name -> (block, keys), joined to the eligible enrolments; rows that a block lacks are left out, and repeated
    keys or missing values raise an error from the run that writes the table. ``colleges`` is a fixed list, the first one the
    baseline. ``baselines``: the variables whose levels are found in the data (see ``fit_levels``); both parts get the columns
    of one stored dictionary. Blocks are written before they are joined: each is a long job of its own, and the assembly a
    short plan over their files; those with the student among their keys are written in buckets of the student. A block ``cluster`` is one of
    :func:`cluster_totals`, whose pair features follow from a row of the assembled table and are put in their place.
    """
    base = eligible.select(*SECTION, flag(F.col("grade").isin(g.PASSED_WELL)).alias("passed"))
    written = {name: (bucketed(block, f"{folder}/{name}", "student") if "student" in keys else sink(block, f"{folder}/{name}"), keys)
               for name, (block, keys) in blocks.items()}
    table, report = assemble_checked(base, written, f"{folder}/assembled", SECTION, dealt_by="student")
    levels = sink(fit_levels(table, baselines, least_share), f"{folder}/levels")
    if "cluster" in blocks:
        narrow = [c for c in blocks["cluster"][0].columns if c not in SECTION]
        at = table.columns.index(narrow[0])
        rest = [c for c in table.columns if c not in narrow]
        table = table.select(*rest[:at], *pair_columns(), *rest[at:])
    wide = encode_levels(one_hot(table, "college", colleges, colleges[0]), levels, unseen)
    return wide.withColumn("valid", flag(F.col("strm") >= valid_from)), levels, report
