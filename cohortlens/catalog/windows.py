"""Ordered rules over the terms of a student."""

from pyspark.sql import functions as F

from cohortlens.catalog.registry import query
from cohortlens.functions.terms import nth_term, term_at
from cohortlens.operators import aggs as a
from cohortlens.operators import ranking as k
from cohortlens.operators import windows as w
from cohortlens.operators.reshape import calendar
from cohortlens.plans.courses import graded, trailing_grades, with_course

PER_TERM = """per AS (SELECT student, strm, sum(credit) AS credit, sum(CASE WHEN grade='W' THEN credit ELSE 0 END) AS withdrawn,
 sum(CASE WHEN grade IN ('A','B','C','D') THEN credit ELSE 0 END)/nullif(sum(CASE WHEN coalesce(grade,'') <> 'W' THEN credit ELSE 0 END),0) AS completed
 FROM enrolment_v GROUP BY student, strm)"""


def per_term(r):
    c, g = F.col("credit"), F.col("grade")
    from cohortlens.functions.nulls import in_list, ratio

    return r.enrolment.groupBy("student", "strm").agg(
        F.sum(c).alias("credit"), a.total_if(c, g == "W").cast("double").alias("withdrawn"),
        ratio(a.total_if(c, g.isin("A", "B", "C", "D")), a.total_if(c, ~in_list(g, ["W"]))).alias("completed"))


SNAP = """snap AS (SELECT student, strm, min_by(distance, source) AS distance, min_by(zcta, source) AS zcta FROM (SELECT *, row_number() OVER (PARTITION BY student, strm ORDER BY source) AS rn FROM snapshot_v) WHERE rn=1 GROUP BY student, strm)"""
SNAP = """snap AS (SELECT student, strm, distance, zcta FROM (SELECT *, row_number() OVER (PARTITION BY student, strm ORDER BY source) AS rn FROM snapshot_v) WHERE rn=1)"""


def snap(r):
    return a.pick(r.snapshots.select("student", "strm", "source", "distance", "zcta"), ["student", "strm"], [F.col("source")]).drop("source")


@query("e01_pick", """
SELECT student, strm, source, total_credit_hrs, deglvl FROM (SELECT *, row_number() OVER (PARTITION BY student, strm
 ORDER BY total_credit_hrs DESC, md5(concat_ws('#', source, '1234')), source) AS rn FROM snapshot_v) WHERE rn=1
""")
def pick(r):
    from cohortlens.functions.codes import seeded_key

    s = r.snapshots.select("student", "strm", "source", "total_credit_hrs", "deglvl")
    return a.pick(s, ["student", "strm"], [-F.col("total_credit_hrs"), seeded_key(1234, F.col("source")), F.col("source")])


@query("e01_pick_last", "SELECT student, strm, source FROM (SELECT *, row_number() OVER (PARTITION BY student ORDER BY strm DESC, source DESC) AS rn FROM snapshot_v) WHERE rn=1")
def pick_last(r):
    return a.pick(r.snapshots.select("student", "strm", "source"), "student", [F.col("strm"), F.col("source")], "last")


@query("e02_latest_source", "SELECT student, source, fhe FROM (SELECT *, max(source) OVER (PARTITION BY student) AS m FROM snapshot_v) WHERE source = m")
def latest_source(r):
    return a.latest_source(r.snapshots.select("student", "source", "fhe"), "student")


@query("e03_term_index", f"WITH {PER_TERM} SELECT student, strm, row_number() OVER (PARTITION BY student ORDER BY strm) AS idx, count(*) OVER (PARTITION BY student) AS n_terms FROM per")
def term_index(r):
    per = r.enrolment.select("student", "strm").distinct()
    return a.with_group_values(per.withColumn("idx", w.term_index("student")), "student", n_terms=F.count(F.lit(1)))


@query("e04_lag_term", f"WITH {PER_TERM} SELECT student, strm, lag(credit) OVER v AS lag_1, lag(credit,2) OVER v AS lag_2 FROM per WINDOW v AS (PARTITION BY student ORDER BY strm)")
def lag_term(r):
    return per_term(r).select("student", "strm", w.lag_term("credit", 1, "student").alias("lag_1"), w.lag_term("credit", 2, "student").alias("lag_2"))


@query("e05_running", f"WITH {PER_TERM} SELECT student, strm, sum(credit) OVER v AS total, sum(withdrawn) OVER v/nullif(sum(credit) OVER v,0) AS ratio FROM per WINDOW v AS (PARTITION BY student ORDER BY strm)")
def running(r):
    return per_term(r).select("student", "strm", w.running_sum("credit", "student").alias("total"), w.running_ratio("withdrawn", "credit", "student").alias("ratio"))


@query("e06_prior_share", f"""WITH {PER_TERM} SELECT student, strm, sum(withdrawn) OVER v/nullif(sum(credit) OVER v,0) AS pct_withdrawn FROM per
WINDOW v AS (PARTITION BY student ORDER BY strm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prior_share(r):
    return per_term(r).select("student", "strm", w.prior_share("withdrawn", "credit", "student").alias("pct_withdrawn"))


@query("e07_expanding_sd", f"""WITH {PER_TERM} SELECT student, strm, stddev_samp(completed) OVER (PARTITION BY student ORDER BY strm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sd FROM per""")
def expanding_sd(r):
    return per_term(r).select("student", "strm", w.expanding_sd("completed", "student").alias("sd"))


@query("e08_ever", """
WITH d AS (SELECT student, strm, max(dual_enrollment) AS dual FROM snapshot_v GROUP BY ALL)
SELECT student, strm, max(dual) OVER (PARTITION BY student ORDER BY strm) AS ever, max(dual) OVER (PARTITION BY student ORDER BY strm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ever_before FROM d
""")
def ever(r):
    d = a.collapse(r.snapshots, ["student", "strm"], dual=F.max("dual_enrollment"))
    return d.select("student", "strm", w.ever("dual", "student").alias("ever"), w.ever("dual", "student", inclusive=False).alias("ever_before"))


@query("e09_trailing_avg_grade", """
WITH g AS (SELECT *, CASE WHEN grade IN ('A','B','C','D','F') THEN credit ELSE 0 END AS w, CASE grade WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 ELSE 0 END AS pts FROM enrolment_v),
terms AS (SELECT DISTINCT strm FROM snapshot_v)
SELECT g.college, g.subject || '_' || g.course_num AS course, t.strm, sum(w*pts)/sum(w) AS avg_grade FROM g JOIN terms t ON g.strm < t.strm AND g.strm >= t.strm - 50
WHERE w > 0 GROUP BY ALL
""")
def trailing_avg_grade(r):
    return trailing_grades(graded(with_course(r.enrolment)), calendar(r.snapshots, "strm"))[0]


@query("e10_locf", f"WITH {SNAP} SELECT student, strm, last_value(distance IGNORE NULLS) OVER (PARTITION BY student ORDER BY strm) AS distance FROM snap")
def locf(r):
    return snap(r).select("student", "strm", w.locf("distance", "student").alias("distance"))


@query("e11_nocb", f"WITH {SNAP} SELECT student, strm, first_value(distance IGNORE NULLS) OVER (PARTITION BY student ORDER BY strm ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS distance FROM snap")
def nocb(r):
    return snap(r).select("student", "strm", w.nocb("distance", "student").alias("distance"))


@query("e12_fill_prev_once", f"WITH {SNAP} SELECT student, strm, coalesce(zcta, lag(zcta) OVER (PARTITION BY student ORDER BY strm)) AS zcta FROM snap")
def fill_prev_once(r):
    return snap(r).select("student", "strm", w.fill_prev_once("zcta", "student").alias("zcta"))


@query("e13_fill_first_known", f"WITH {SNAP} SELECT student, strm, coalesce(zcta, first_value(zcta IGNORE NULLS) OVER (PARTITION BY student ORDER BY strm ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS zcta FROM snap")
def fill_first_known(r):
    return snap(r).select("student", "strm", w.fill_first_known("zcta", "student").alias("zcta"))


@query("e14_fill_if_unique", """
SELECT student, strm, college, subject, course_num, section, coalesce(grade, CASE WHEN min(grade) OVER p = max(grade) OVER p THEN min(grade) OVER p END) AS grade
FROM enrolment_v WINDOW p AS (PARTITION BY student, strm, subject, course_num)
""")
def fill_if_unique(r):
    e = r.enrolment.drop("instructor", "credit", "day_eve_code")
    return w.fill_if_unique(e, ["student", "strm", "subject", "course_num"], "grade")


def trend_ctes(table: str, x: str, p: str = "") -> str:
    """Tables ending in ``{p}trend`` (student, strm, trend), by explicit suffix regressions."""
    return f"""{p}v AS (SELECT student, strm, {x} AS v, row_number() OVER (PARTITION BY student ORDER BY strm) AS i FROM {table} WHERE {x} IS NOT NULL),
{p}h AS (SELECT t.student, t.strm, v.v, row_number() OVER (PARTITION BY t.student, t.strm ORDER BY v.i) AS pos, count(*) OVER (PARTITION BY t.student, t.strm) AS n
  FROM {table} t JOIN {p}v v ON v.student=t.student AND v.strm < t.strm),
{p}f AS (SELECT a.student, a.strm, a.pos AS start, regr_slope(b.v, b.pos) AS slope, regr_r2(b.v, b.pos) AS r2, var_pop(b.v) AS vv FROM {p}h a JOIN {p}h b ON a.student=b.student AND a.strm=b.strm AND b.pos >= a.pos
  WHERE a.n - a.pos + 1 >= 3 GROUP BY ALL),
{p}best AS (SELECT student, strm, slope FROM (SELECT *, row_number() OVER (PARTITION BY student, strm ORDER BY CASE WHEN vv < 1e-12 THEN 1.0 ELSE round(r2,9) END DESC, start) AS rn FROM {p}f) WHERE rn=1),
{p}two AS (SELECT student, strm, max(CASE WHEN pos=2 THEN v END) - max(CASE WHEN pos=1 THEN v END) AS d FROM {p}h WHERE n=2 GROUP BY ALL),
{p}trend AS (SELECT t.student, t.strm, coalesce(b.slope, w.d, 0) AS trend FROM {table} t LEFT JOIN {p}best b USING (student, strm) LEFT JOIN {p}two w USING (student, strm))"""


@query("e15_best_suffix_trend", f"WITH {PER_TERM}, {trend_ctes('per', 'completed')} SELECT * FROM trend")
def best_suffix_trend(r):
    return w.best_suffix_trend(per_term(r), "student", "strm", "completed").select("student", "strm", "trend")


@query("e16_nth_term", """
WITH f AS (SELECT student, min(strm) AS first FROM snapshot_v GROUP BY student), d AS (SELECT DISTINCT student, strm, first FROM snapshot_v JOIN f USING (student)),
y AS (SELECT *, floor((strm-first)/10) AS yr FROM d)
SELECT student, strm, (3*yr + CASE strm-first-10*yr WHEN 8 THEN 1 WHEN 9 THEN 2 ELSE strm-first-10*yr END + 1)::INT AS nth, strm AS back FROM y
""")
def nth(r):
    first = a.collapse(r.snapshots, "student", first=F.min("strm"))
    d = r.snapshots.select("student", "strm").distinct().join(first, "student")
    n = nth_term(F.col("first"), F.col("strm"))
    return d.select("student", "strm", n.alias("nth"), term_at(F.col("first"), n).alias("back"))


@query("e17_pct_stopped", """
WITH t AS (SELECT DISTINCT student, strm FROM enrolment_v), f AS (SELECT *, min(strm) OVER (PARTITION BY student) AS first,
 count(*) FILTER (WHERE strm % 10 <> 3) OVER (PARTITION BY student ORDER BY strm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS attended FROM t),
g AS (SELECT *, (SELECT count(*) FROM (SELECT unnest(range(1900,2100)) AS c) WHERE c % 10 IN (2,4) AND c >= f.first AND c < f.strm) AS possible FROM f)
SELECT student, strm, (possible - attended)/nullif(possible,0)::DOUBLE AS pct_stopped FROM g
""")
def pct_stopped(r):
    from cohortlens.plans.terms import stop_out

    return stop_out(r.enrolment.select("student", "strm").distinct()).select("student", "strm", "pct_stopped")


@query("e18_nth_smallest", "SELECT grp, score AS value FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score) AS rn FROM scores_v) WHERE rn=100")
def nth_smallest(r):
    return k.nth_smallest(r.scores, "grp", "score", F.lit(100))


@query("e19_ordinal_rank", "SELECT id, row_number() OVER (ORDER BY score, md5(concat_ws('#', id, '4321')), id) AS rank FROM scores_v")
def ordinal_rank(r):
    return k.ordinal_rank(r.scores, [], "score", "id", 4321).select("id", "rank")


@query("e20_age_at", """
WITH f AS (SELECT student, min_by(strm, source) AS ref_strm, min_by(18 + source % 30, source) AS ref_age FROM snapshot_v GROUP BY student)
SELECT s.source, (ref_age + floor((s.strm - ref_strm)/10))::BIGINT AS age FROM snapshot_v s JOIN f USING (student)
""")
def age_at(r):
    from cohortlens.plans.terms import age_at_term

    s = r.snapshots.select("student", "source", "strm", (18 + F.col("source") % 30).alias("age"))
    ref = a.pick(s, "student", [F.col("source")]).select("student", F.col("strm").alias("ref_strm"), F.col("age").alias("ref_age"))
    return s.select("student", "source", "strm").join(ref, "student").select("source", age_at_term("ref_age", "ref_strm", "strm").alias("age"))


@query("e21_leave_one_out", """
WITH p AS (SELECT student, strm, college, subject, course_num, sum(credit) AS w, avg(section)::DOUBLE AS x FROM enrolment_v GROUP BY ALL)
SELECT student, strm, college, subject, course_num, (sum(x*w) OVER v - x*w)/nullif(sum(w) OVER v - w, 0) AS others FROM p WINDOW v AS (PARTITION BY student, strm)
""")
def leave_one_out(r):
    keys = ["student", "strm", "college", "subject", "course_num"]
    p = r.enrolment.groupBy(*keys).agg(F.sum("credit").alias("w"), F.avg("section").alias("x"))
    return w.leave_one_out(p, ["student", "strm"], "x", "w", "others").drop("x", "w")
