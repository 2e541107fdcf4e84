"""Student-level feature jobs (one row per student, or student x term before the last fold)."""

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.functions import grades as g
from cohortlens.functions.codes import DEGREE_LEVELS, degree_rank, missing_code, seeded_key
from cohortlens.functions.grades import audit_halved, clean_course_number, effective_credit, points
from cohortlens.functions.nulls import flag, in_list, is_true, ratio, zero
from cohortlens.functions.terms import last_observed_term, nth_term, year_of
from cohortlens.operators import windows as w
from cohortlens.operators.aggs import latest_source, min_entropy, mode_by, pick, total, total_if
from cohortlens.sources.buckets import bucketed


def demographic_flags(snaps: DataFrame) -> DataFrame:
    """Flags from the latest source of each student: student, source, race, gender, age."""
    last = latest_source(snaps, "student")
    known = last.withColumn("race", F.when(~F.col("race").isin(0, 7), F.col("race")))
    race = mode_by(known, "student", "race")
    complete = known.groupBy("student").agg(F.max(flag(F.col("race").isNull())).alias("__missing"), F.min("age").alias("age"),
                                            F.min(flag(F.col("race").isNull())).alias("__all"))
    both = race.join(complete, "student").join(mode_by(last, "student", "gender"), "student")
    code = F.when(F.col("race").isNull() & (F.col("__all") == 0), 8).otherwise(F.col("race"))
    both = both.withColumn("race", code)
    return both.select("student", "age", flag(F.col("gender") == "M").alias("male"),
                       *[flag(F.col("race") == i).alias(n) for n, i in (("white", 1), ("afam", 2), ("hisp", 3), ("asian", 4))],
                       flag(F.col("race").isin(5, 6, 8)).alias("other"))


def outcomes(records: DataFrame, degrees: DataFrame, kinds, window_terms: int = 18) -> DataFrame:
    """Graduation and outside enrolment within six years of entry, first such terms, degrees by level.

    ``records``: student, strm, first, grad_own, grad_other, enr_other. ``degrees``: student and
    ``deg_{kind}``, ``deg_{kind}_strm``; degrees after the window are cleared, none at all counts as 0.
    """
    inside = nth_term(F.col("first"), F.col("strm")).between(1, window_terms)
    seen = {c: F.when(inside, F.col(c)) for c in ("grad_own", "grad_other", "enr_other")}
    rows = records.withColumns({f"{c}_6years": v for c, v in seen.items()})
    graduated = is_true(F.col("grad_own_6years") == 1) | is_true(F.col("grad_other_6years") == 1)
    out = rows.groupBy("student", "first").agg(
        *[F.max(f"{c}_6years").alias(f"{c}_6years") for c in seen],
        F.min(F.when(graduated, F.col("strm"))).alias("first_degree_strm"),
        F.min(F.when(F.col("enr_other_6years") == 1, F.col("strm"))).alias("first_other_strm"))
    out = out.withColumn("last_strm", last_observed_term(F.col("first"))).join(degrees, "student", "left")
    fixed = {}
    for k in kinds:
        late = is_true(F.col(f"deg_{k}_strm") > F.col("last_strm"))
        fixed |= {f"deg_{k}": F.when(late, 0).otherwise(zero(F.col(f"deg_{k}"))),
                  f"deg_{k}_strm": F.when(~late, F.col(f"deg_{k}_strm"))}
    return out.withColumns(fixed)


def elapsed_terms(enrolled: DataFrame, outcome: DataFrame, current_terms, longest: int = 17) -> DataFrame:
    """Students of the current terms who have not graduated yet: consecutive number of the current term."""
    now = enrolled.where(F.col("strm").isin(list(current_terms))).select("student", F.col("strm").alias("crnt_strm")).distinct()
    open_ = now.join(outcome.select("student", "first", "first_degree_strm"), "student")
    open_ = open_.where(~is_true(F.col("first_degree_strm") <= F.col("crnt_strm")) & (F.col("first") <= F.col("crnt_strm")))
    return open_.select("student", "crnt_strm", nth_term(F.col("first"), F.col("crnt_strm")).alias("nth_term")).where(
        F.col("nth_term") <= longest)


def term_record(classes: DataFrame, gpa_credits: DataFrame, folder: str) -> DataFrame:
    """Term academic record: attempted, earned, withdrawn, level and developmental credit, GPA, college mix.

    ``gpa_credits``: student, strm, term_cred_gpa; class credits are scaled up to it where they fall short. The sums by term and
    college, which are read twice, are stored below ``folder`` in buckets of the student.
    """
    from cohortlens.plans.courses import fill_grades

    grade, num = F.col("grade"), F.col("course_num")
    rows = fill_grades(classes).withColumn("credit", audit_halved(F.col("credit"), grade))
    c, attempted, eff = F.col("credit"), ~in_list(grade, g.NOT_ATTEMPTED), effective_credit(F.col("credit"), grade)
    sums = {"credit": F.sum(c), "term_withdrawn": total_if(c, grade == "W"), "term_cred_earn": total_if(c, in_list(grade, g.EARNED)),
            "term_cred_att_2": total_if(c, attempted), "term_lvl2_att": total_if(c, g.is_second_year(num) & attempted),
            "term_dev_att": total_if(c, g.is_developmental(num) & attempted),
            "eff": F.sum(eff), "points": F.sum(eff * points(grade))}
    # The scale factor is one number per student-term, so it is applied to sums, not to rows.
    per = rows.groupBy("student", "strm", "college").agg(*[v.cast("double").alias(k) for k, v in sums.items()])
    colleges = Window.partitionBy("student", "strm")
    per = per.join(gpa_credits, ["student", "strm"], "left").withColumn("wanted", zero(F.col("term_cred_gpa")).cast("double"))
    short = F.sum("credit").over(colleges)
    per = per.withColumn("factor", F.when(short < F.col("wanted"), F.coalesce(ratio(F.col("wanted"), short), F.lit(1.0))).otherwise(1.0))
    per = bucketed(per, f"{folder}/by_college", "student", dealt=True)
    scaled = ["term_withdrawn", "term_cred_earn", "term_cred_att_2", "term_lvl2_att", "term_dev_att"]
    terms = per.groupBy("student", "strm").agg(
        F.greatest(F.sum("credit"), F.max("wanted")).alias("term_cred_att"),
        *[F.sum(F.col(s) * F.col("factor")).alias(s) for s in scaled], ratio(F.sum("points"), F.sum("eff")).alias("term_gpa"),
    ).where("term_cred_att > 0")
    mix = min_entropy(per.withColumn("scaled", F.col("credit") * F.col("factor")), "student", "college", "scaled", "college_entropy")
    return terms.join(mix, "student", "left")


def program_record(snaps: DataFrame, enrolled: DataFrame, seed=1234) -> DataFrame:
    """Program of each term of the window: degree seeking; dual, seamless entry and program change per student.

    ``snaps``: student, strm, source, curr, curr_degree, total_credit_hrs, dual_enrollment, hs_year.
    ``enrolled``: student, strm, first, enrolled (0/1).
    """
    keys = ["student", "strm"]
    dual = snaps.groupBy(*keys).agg(F.max("dual_enrollment").alias("dual"))
    order = [-F.col("total_credit_hrs"), -degree_rank(F.col("curr_degree")), seeded_key(seed, F.col("source"))]
    top = pick(snaps.select(*keys, "source", "curr", "curr_degree", "total_credit_hrs", "hs_year"), keys, order)
    top = top.withColumn("seeking", flag(~is_true(F.col("curr").rlike("^0"))))
    all_terms = enrolled.join(top.join(dual, keys).select(*keys, "curr", "seeking", "hs_year", "dual"), keys, "full_outer")
    active = is_true(F.col("enrolled") == 1)
    rows = all_terms.withColumns({
        "degree_seeking": F.when(active, F.coalesce("seeking", F.lit(1))).otherwise(
            F.when(F.col("enrolled").isNull(), F.col("seeking")).otherwise(0)),
        "curr": F.when(is_true(F.col("enrolled") == 0), None).otherwise(F.col("curr")),
    })
    year = mode_by(rows, "student", "hs_year", "max")
    flags = rows.groupBy("student").agg(F.max("dual").alias("dual_ind"), flag(F.count_distinct("curr") > 1).alias("program_chng_ind"))
    entry = year_of(F.col("first"))
    return rows.where("enrolled is not null").join(year.withColumnRenamed("hs_year", "__hs"), "student").join(flags, "student").select(
        *keys, "degree_seeking", "dual_ind", flag(F.col("__hs") < entry).alias("seamless_enrollee_0"),
        flag(F.col("__hs") == entry).alias("seamless_enrollee_1"), "program_chng_ind")


def pre_entry(entry: DataFrame, gpa_file: DataFrame, classes: DataFrame, snaps: DataFrame, known_gpa: DataFrame) -> DataFrame:
    """Credits, completion and GPA before entry.

    ``entry``: student, first. ``gpa_file``: student, strm, college, taken, passed (running totals).
    ``known_gpa``: student, strm, cum_gpa. The GPA file is used where it covers the student, else the
    class file; college-level credit prefers the student snapshots.
    """
    before = lambda df: df.join(entry, "student").where(F.col("strm") < F.col("first"))
    last = before(gpa_file).groupBy("student", "college").agg(
        F.max_by("taken", F.when(F.col("taken").isNotNull(), F.col("strm"))).alias("taken"),
        F.max_by("passed", F.when(F.col("passed").isNotNull(), F.col("strm"))).alias("passed"))
    from_gpa = last.where(~is_true(F.col("taken") == 0)).groupBy("student").agg(total("taken").alias("taken"), total("passed").alias("passed"))
    rows = before(classes).withColumn("course_num", clean_course_number(F.col("course_num")))
    c, grade = F.col("credit"), F.col("grade")
    attempted = rows.where("credit <> 0").groupBy("student").agg(
        total_if(c, ~in_list(grade, ["W", "X"])).cast("double").alias("prev_att"),
        total_if(c, in_list(grade, g.EARNED)).cast("double").alias("prev_earn"),
        total_if(c, in_list(grade, ["A", "B", "C", "D"]) & g.is_developmental(F.col("course_num"))).cast("double").alias("prev_dev"))
    hours = before(snaps.where("total_credit_hrs <> 0")).groupBy("student").agg(F.sum("total_credit_hrs").alias("hours"))
    recorded = before(known_gpa).groupBy("student").agg(
        F.max_by("cum_gpa", "strm").alias("gpa_recorded"))
    counted = in_list(grade, g.EFFECTIVE)
    computed = rows.groupBy("student").agg(ratio(F.sum(F.when(counted, c * points(grade))), F.sum(F.when(counted, c))).alias("gpa_computed"))
    j = entry
    for block in (from_gpa.withColumn("in_gpa", F.lit(1)), attempted.withColumn("in_class", F.lit(1)), hours, recorded, computed):
        j = j.join(block, "student", "left")
    taken, passed = F.coalesce("taken", "prev_att"), F.coalesce("passed", "prev_earn")
    seen = F.col("in_gpa").isNotNull() | F.col("in_class").isNotNull() | F.col("hours").isNotNull()
    level = F.coalesce(F.when(F.col("in_gpa").isNull() & F.col("in_class").isNotNull(), F.col("hours") - zero(F.col("prev_dev"))).otherwise(F.col("hours")),
                       passed - zero(F.col("prev_dev")))
    return j.where(seen).select("student", F.lit(1).alias("enrolled_pre"), (level / 30).alias("coll_lvl_cred_earn"),
                                ratio(passed, taken).alias("prop_comp_pre"), F.coalesce("gpa_recorded", "gpa_computed").alias("cum_gpa_pre"))


def cumulative_gpa(last_terms: DataFrame, classes: DataFrame) -> DataFrame:
    """Recorded cumulative GPA at the last term, or the one computed from courses up to it.

    ``last_terms``: student, last_term, cum_gpa.
    """
    rows = classes.join(last_terms.where("cum_gpa is null"), "student").where(F.col("strm") <= F.col("last_term"))
    c, counted = F.col("credit"), in_list(F.col("grade"), g.EFFECTIVE)
    computed = rows.groupBy("student").agg(
        ratio(F.sum(F.when(counted, c * points(F.col("grade")))), F.sum(F.when(counted, c))).alias("computed"))
    return last_terms.join(computed, "student", "left").select("student", F.coalesce("cum_gpa", "computed").alias("cum_gpa"))


def repeated_courses(classes: DataFrame, repeatable: DataFrame) -> DataFrame:
    """Per student-term: how many courses of the term were taken in an earlier term, repeatable ones aside."""
    taken = classes.where(~in_list(F.col("grade"), ["X", "XN", "W"])).select(
        "student", "strm", F.concat("subject", clean_course_number(F.col("course_num"))).alias("course")).distinct()
    taken = taken.join(repeatable, "course", "left_anti")
    again = w.term_index(["student", "course"]) > 1
    return taken.withColumn("again", flag(again)).groupBy("student", "strm").agg(F.sum("again").alias("repeated"))


def student_totals(record: DataFrame) -> DataFrame:
    """Overall completion shares and their spread over the terms of a student."""
    rows = record.withColumns({"prop": ratio(F.col("term_cred_earn"), F.col("term_cred_att_2")),
                               "wprop": ratio(F.col("term_withdrawn"), F.col("term_cred_att"))})
    share = lambda a, b: ratio(F.sum(a), F.sum(b))
    return rows.groupBy("student").agg(
        share("term_cred_earn", "term_cred_att_2").alias("prop_comp"), share("term_withdrawn", "term_cred_att").alias("withdrawn_prop_comp"),
        share("term_lvl2_att", "term_cred_att_2").alias("lvl2_prop_comp"), share("term_dev_att", "term_cred_att_2").alias("dev_prop_comp"),
        F.stddev_samp("prop").alias("prop_comp_sd"), F.stddev_samp("wprop").alias("withdrawn_prop_comp_sd"),
        F.max("college_entropy").alias("college_entropy"))


def student_tables(record: DataFrame, repeats: DataFrame, aid_years: DataFrame, folder: str, buckets: int | None = None) -> dict:
    """The tables that student features are made of, in buckets of the student: ``terms`` (the record of each term with its
    repeated courses), ``repeats`` and ``aid``. Each is dealt by student once, when it is written."""
    terms = record.join(repeats, ["student", "strm"], "left")
    tables = {"terms": terms, "repeats": repeats, "aid": aid_years}
    return {name: bucketed(table, f"{folder}/{name}", "student", buckets) for name, table in tables.items()}


def student_features(tables: dict, blocks=(), slots=None) -> DataFrame:
    """Final student table: overall shares, term slots, log aid, repeat flag, and the slot-free attendance share.

    ``tables`` as :func:`student_tables` gives them. Everything here groups and joins by student, so on these buckets nothing is
    shuffled; ``blocks`` are further tables of one row per student, in the same buckets if they are to cost no shuffle either.
    """
    from cohortlens.functions.terms import SLOTS
    from cohortlens.operators.joins import assemble
    from cohortlens.operators.reshape import term_slots

    slots = slots or SLOTS
    record, aid = tables["terms"], tables["aid"]
    terms = record.withColumns({
        "repeat": zero(F.col("repeated")), "enrolled": F.lit(1), "prop_comp_term": ratio(F.col("term_cred_earn"), F.col("term_cred_att_2")),
        "first": F.min("strm").over(Window.partitionBy("student"))})
    wide = term_slots(terms, "student", "first", "strm", ["enrolled", "term_cred_att", "term_gpa", "prop_comp_term", "repeat"], slots)
    ever = tables["repeats"].groupBy("student").agg(flag(F.max("repeated") > 0).alias("repeat_ind"))
    logged = aid.select("student", *[F.log1p(c).alias(c) for c in aid.columns if c != "student"])
    out = assemble(student_totals(record), [wide, ever, logged, *blocks], "student")
    attended = sum((F.col(f"enrolled_{s}") for s in slots), F.lit(0))
    return out.withColumns({"repeat_ind": zero(F.col("repeat_ind")), "pct_enrolled": attended / F.lit(17.0)})


def first_generation(snaps: DataFrame) -> DataFrame:
    """First-generation flags from the latest source; the education code counts only when both parents' are known."""
    known = latest_source(snaps.select("student", "source", zero(F.col("fhe")).alias("fhe"), zero(F.col("mhe")).alias("mhe")), "student")
    both = known.groupBy("student").agg(F.max("fhe").alias("fhe"), F.max("mhe").alias("mhe"))
    phe = F.when(F.least("fhe", "mhe") == 0, 0).otherwise(F.greatest("fhe", "mhe"))
    return both.select("student", flag(phe > 3).alias("firstgen_0"), flag((phe > 0) & (phe <= 3)).alias("firstgen_1"))


def neighbourhood(snaps: DataFrame, area: DataFrame) -> DataFrame:
    """Income and poverty of the home area per student-term with missing-type codes.

    ``snaps``: student, strm, source, total_credit_hrs, zcta. ``area``: zcta, year, income, poverty. An
    unknown area takes the student's usual one, then that of the term before, then the first known one.
    """
    rows = pick(snaps.select("student", "strm", "source", "total_credit_hrs", "zcta"), ["student", "strm"],
                [-F.col("total_credit_hrs"), F.col("source")]).select("student", "strm", "zcta")
    rows = rows.withColumn("kind", flag(F.col("zcta").isNull()))
    usual = mode_by(rows, "student", "zcta", "null", "usual")
    bad = F.col("zcta").isNull() | (F.length("zcta") < 5)
    rows = rows.join(usual, "student").withColumn("zcta", F.when(bad, F.col("usual")).otherwise(F.col("zcta"))).drop("usual")
    rows = rows.withColumn("zcta", w.fill_prev_once("zcta", "student"))
    rows = rows.withColumn("zcta", w.fill_first_known("zcta", "student"))
    rows = rows.withColumn("kind", F.when(F.col("zcta").isNull(), 2).otherwise(F.col("kind")))
    joined = rows.withColumns({"zcta": F.coalesce("zcta", F.lit("00000")), "year": year_of(F.col("strm"))}).join(area, ["zcta", "year"], "left")
    means = joined.agg(F.struct(F.avg("income").alias("income"), F.avg("poverty").alias("poverty"))).scalar()
    gap = {c: flag(F.col(c).isNull()) for c in ("income", "poverty")}
    return joined.withColumn("__m", means).select(
        "student", "strm", "zcta", *[missing_code(F.col("kind"), v).alias(f"{c}_mi_type") for c, v in gap.items()],
        *[F.coalesce(F.col(c).cast("double"), F.col("__m")[c]).alias(c) for c in gap])


def home_distance(snaps: DataFrame) -> DataFrame:
    """Distance to college: carried forward, then back; a student without any gets the mean."""
    rows = pick(snaps.select("student", "strm", "source", "total_credit_hrs", "distance"), ["student", "strm"],
                [-F.col("total_credit_hrs"), F.col("source")]).select("student", "strm", "distance")
    rows = rows.withColumns({"kind": flag(F.col("distance").isNull()), "distance": w.locf("distance", "student")})
    rows = rows.withColumn("distance", w.nocb("distance", "student"))
    mean = rows.agg(F.avg("distance")).scalar()
    return rows.select("student", "strm", F.when(F.col("distance").isNull(), 2).otherwise(F.col("kind")).alias("distance_mi_type"),
                       F.coalesce("distance", mean).alias("distance"))


def degree_level_at(snaps: DataFrame, last_terms: DataFrame) -> DataFrame:
    """Credential level at the last term: per term the lowest known level, larger credit first."""
    level = F.when(F.col("deglvl").isin(DEGREE_LEVELS), F.col("deglvl")).otherwise("OTHER")
    rows = snaps.select("student", "strm", "source", "total_credit_hrs", level.alias("level"))
    one = pick(rows, ["student", "strm"], [F.col("level"), -F.col("total_credit_hrs"), F.col("source")])
    return last_terms.join(one.select("student", F.col("strm").alias("last_term"), "level"), ["student", "last_term"], "left").select(
        "student", F.coalesce("level", F.lit("OTHER")).alias("deglvl"))


def program_at(snaps: DataFrame, keys, order) -> DataFrame:
    """College and program of a student-term under a priority order."""
    return pick(snaps, keys, order)
