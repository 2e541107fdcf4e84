"""Aggregates."""

from pyspark.sql import functions as F

from cohortlens.catalog.registry import query
from cohortlens.functions.codes import GROUPS
from cohortlens.operators import aggs as a
from cohortlens.operators import rows as o
from cohortlens.plans.aid import allocate_terms, term_aid

WEIGHT = "CASE WHEN grade IN ('A','B','C','D','F') THEN credit ELSE 0 END"
PTS = "CASE grade WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 ELSE 0 END"


@query("d01_collapse", """
SELECT student, strm, max(total_credit_hrs) AS hi, min(total_credit_hrs) AS lo, coalesce(sum(distance),0) AS total, avg(distance) AS mean,
 count(distance) AS n, min_by(source, source) AS first_source FROM snapshot_v GROUP BY student, strm
""")
def collapse(r):
    return a.collapse(r.snapshots, ["student", "strm"], hi=F.max("total_credit_hrs"), lo=F.min("total_credit_hrs"),
                      total=a.total("distance"), mean=F.avg("distance"), n=F.count("distance"),
                      first_source=F.min_by("source", "source"))


@query("d02_group_value", """
SELECT student, strm, college, subject, course_num, section, sum(credit) OVER (PARTITION BY student, strm) AS term_credit,
 max(credit) OVER (PARTITION BY college) AS college_max, count(*) OVER (PARTITION BY grade) AS same_grade FROM enrolment_v
""")
def group_value(r):
    e = r.enrolment.drop("instructor", "day_eve_code")
    return a.with_values_of_groups(
        e, (["student", "strm"], {"term_credit": F.sum("credit")}), ("college", {"college_max": F.max("credit")}),
        ("grade", {"same_grade": F.count(F.lit(1))})).drop("credit", "grade")


@query("d03_group_sum_if", """
SELECT source, coalesce(max(s) OVER (PARTITION BY student), 0) AS early_hours FROM (
 SELECT *, sum(total_credit_hrs) FILTER (WHERE strm < 1990) OVER (PARTITION BY student)::BIGINT AS s FROM snapshot_v)
""")
def group_sum_if(r):
    s = r.snapshots.select("source", "student", "strm", "total_credit_hrs")
    return a.with_group_values(s, "student", early_hours=a.total_if(F.col("total_credit_hrs"), F.col("strm") < 1990)).select(
        "source", "early_hours")


@query("d04_nvals", "SELECT student, count(DISTINCT deglvl) AS n_values FROM snapshot_v GROUP BY student")
def nvals(r):
    return a.nvals(r.snapshots, "student", "deglvl")


@query("d05_row_total_max", """
SELECT source, coalesce(fhe,0)+coalesce(mhe,0)+coalesce(distance,0) AS total, greatest(fhe, mhe) AS best FROM snapshot_v
""")
def row_total_max(r):
    return r.snapshots.select("source", o.row_total(["fhe", "mhe", "distance"]).alias("total"), o.row_max(["fhe", "mhe"]).alias("best"))


@query("d06_weighted_mean", f"""
SELECT student, strm, sum({WEIGHT}*{PTS})/nullif(sum({WEIGHT}),0) AS term_gpa FROM enrolment_v GROUP BY student, strm
""")
def weighted_mean(r):
    from cohortlens.functions.grades import COUNTED, effective_credit, points

    w = effective_credit(F.col("credit"), F.col("grade"), COUNTED)
    return r.enrolment.groupBy("student", "strm").agg(a.mean_of(points(F.col("grade")), w).alias("term_gpa"))


@query("d07_weighted_mean_skipna", """
SELECT s.student, sum(s.intensity*v.quality)/nullif(sum(CASE WHEN v.quality IS NOT NULL THEN s.intensity END),0) AS quality
FROM spells_v s JOIN (SELECT n_name AS college, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey*1.5::DOUBLE END AS quality FROM nation) v USING (college) GROUP BY s.student
""")
def weighted_mean_skipna(r):
    quality = r.table("nation").select(F.col("n_name").alias("college"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey") * 1.5).alias("quality"))
    return r.spells.join(quality, "college").groupBy("student").agg(a.mean_of_known(F.col("quality"), F.col("intensity")).alias("quality"))


def _mode_sql(pick):
    return f"""WITH c AS (SELECT student, deglvl, count(*) AS n FROM snapshot_v WHERE deglvl IS NOT NULL GROUP BY student, deglvl),
b AS (SELECT student, count(*) AS ties, min(deglvl) AS lo, max(deglvl) AS hi FROM c WHERE n = (SELECT max(n) FROM c c2 WHERE c2.student=c.student) GROUP BY student)
SELECT s.student, {pick} AS deglvl FROM (SELECT DISTINCT student FROM snapshot_v) s LEFT JOIN b USING (student)"""


@query("d08_mode_null_on_tie", _mode_sql("CASE WHEN ties=1 THEN lo END"))
def mode_null(r):
    return a.mode_by(r.snapshots, "student", "deglvl")


@query("d08_mode_min_on_tie", _mode_sql("lo"))
def mode_min(r):
    return a.mode_by(r.snapshots, "student", "deglvl", "min")


@query("d08_mode_max_on_tie", _mode_sql("hi"))
def mode_max(r):
    return a.mode_by(r.snapshots, "student", "deglvl", "max")


@query("d09_multiple_mode", """
WITH c AS (SELECT student, fhe, count(*) AS n FROM snapshot_v WHERE fhe IS NOT NULL GROUP BY student, fhe),
b AS (SELECT student, count(*) AS ties, min(fhe) AS lo FROM c WHERE n = (SELECT max(n) FROM c c2 WHERE c2.student=c.student) GROUP BY student),
k AS (SELECT student, max((fhe IS NULL)::INT) AS unknown FROM snapshot_v GROUP BY student)
SELECT k.student, CASE WHEN ties=1 THEN lo WHEN unknown=0 THEN 8 END AS code FROM k LEFT JOIN b USING (student)
""")
def multiple_mode(r):
    return a.multiple_mode(r.snapshots, "student", "fhe", 8, "code")


@query("d10_share", """
SELECT strm, college, credit/nullif(sum(credit) OVER (PARTITION BY strm),0) AS share FROM (SELECT strm, college, sum(credit) AS credit FROM enrolment_v GROUP BY ALL)
""")
def share(r):
    per = r.enrolment.groupBy("strm", "college").agg(F.sum("credit").alias("credit"))
    return a.share(per, "strm", "credit").drop("credit")


@query("d11_credit_share", """
SELECT student, strm, sum(CASE WHEN course_num LIKE '2__' THEN credit ELSE 0 END)/nullif(sum(credit),0) AS level2_share,
 sum(CASE WHEN day_eve_code='E' THEN credit ELSE 0 END)/nullif(sum(credit),0) AS eve_share,
 sum(CASE WHEN grade='W' THEN credit ELSE 0 END)/nullif(sum(credit),0) AS withdrawn_share FROM enrolment_v GROUP BY student, strm
""")
def credit_share(r):
    from cohortlens.functions.grades import is_second_year

    c = F.col("credit")
    return r.enrolment.groupBy("student", "strm").agg(
        a.share_of(c, is_second_year(F.col("course_num"))).alias("level2_share"),
        a.share_of(c, F.col("day_eve_code") == "E").alias("eve_share"), a.share_of(c, F.col("grade") == "W").alias("withdrawn_share"))


@query("d12_min_entropy", """
SELECT student, CASE WHEN sum(w) > 0 THEN -ln(max(w)/sum(w)) END AS min_entropy FROM (SELECT student, college, sum(credit) AS w FROM enrolment_v GROUP BY ALL) GROUP BY student
""")
def min_entropy(r):
    return a.min_entropy(r.enrolment, "student", "college", "credit")


@query("d13_rescale_to_total", """
WITH g AS (SELECT student, strm, max(total_credit_hrs) AS wanted FROM snapshot_v GROUP BY ALL),
e AS (SELECT *, sum(credit) OVER (PARTITION BY student, strm) AS tot FROM enrolment_v)
SELECT e.student, e.strm, e.college, e.subject, e.course_num, e.section, CASE WHEN tot < wanted THEN coalesce(credit*wanted/nullif(tot,0), credit) ELSE credit END AS scaled
FROM e JOIN g USING (student, strm)
""")
def rescale_to_total(r):
    wanted = r.snapshots.groupBy("student", "strm").agg(F.max("total_credit_hrs").alias("wanted"))
    e = r.enrolment.select("student", "strm", "college", "subject", "course_num", "section", "credit").join(wanted, ["student", "strm"])
    return a.rescale_to_total(e, ["student", "strm"], "credit", "wanted", "scaled").drop("credit", "wanted")


AID_TERMS = """
p AS (SELECT *, credspr+credsum+credfal AS credall FROM aid_v),
t AS (SELECT student, CASE term WHEN 2 THEN year+1 ELSE year END AS year, term, budget, pell*share AS pell, grants*share AS grants FROM (
  SELECT student, year, 2 AS term, budget, pell, grants, credspr/credall::DOUBLE AS share FROM p UNION ALL
  SELECT student, year, 3, budget, pell, grants, credsum/credall::DOUBLE FROM p UNION ALL
  SELECT student, year, 4, budget, pell, grants, credfal/credall::DOUBLE FROM p))"""


@query("d14_allocate_terms", f"WITH {AID_TERMS} SELECT student, (10*(year-1800)+term)::INT AS strm, budget, pell, grants FROM t")
def allocate(r):
    return allocate_terms(r.aid)


@query("d15_rate_table", "SELECT home, " + ", ".join(
    f"avg(CASE WHEN grp='{g}' THEN y END) AS {g}" for g in GROUPS) + """
FROM (SELECT v.home, v.grp, q.y FROM scores_v q JOIN orders o ON o.o_orderkey=q.id JOIN student_v v ON v.student=o.o_custkey) GROUP BY home""")
def rate_table(r):
    return a.rate_table(_scored_homes(r), "home", "grp", GROUPS, "y")


@query("d15_share_table", "SELECT home, count(*) AS n, " + ", ".join(
    f"sum((grp='{g}')::INT)/count(*)::DOUBLE AS {g}" for g in GROUPS) + """
FROM (SELECT v.home, v.grp, q.y FROM scores_v q JOIN orders o ON o.o_orderkey=q.id JOIN student_v v ON v.student=o.o_custkey) GROUP BY home""")
def share_table(r):
    return a.share_table(_scored_homes(r), "home", "grp", GROUPS)


def _scored_homes(r):
    return r.scores.join(r.orders, F.col("id") == F.col("o_orderkey")).join(
        r.students.select("student", "home"), F.col("o_custkey") == F.col("student"))


@query("d16_group_sd", "SELECT student, stddev_samp(distance) AS sd FROM snapshot_v GROUP BY student")
def group_sd(r):
    return a.collapse(r.snapshots, "student", sd=F.stddev_samp("distance"))


@query("d17_sample_counts", """
SELECT count(DISTINCT student) FILTER (WHERE strm < 2000) AS students_train, count(DISTINCT student) FILTER (WHERE strm >= 2000) AS students_test,
 count(DISTINCT subject || '_' || course_num) FILTER (WHERE strm < 2000) AS courses_train, count(DISTINCT subject || '_' || course_num) FILTER (WHERE strm >= 2000) AS courses_test,
 count(DISTINCT college || '#' || subject || '_' || course_num) AS college_courses FROM enrolment_v
""")
def sample_counts(r):
    course = F.concat_ws("_", "subject", "course_num")
    old, new = F.col("strm") < 2000, F.col("strm") >= 2000
    return r.enrolment.agg(
        F.count_distinct(F.when(old, F.col("student"))).alias("students_train"), F.count_distinct(F.when(new, F.col("student"))).alias("students_test"),
        F.count_distinct(F.when(old, course)).alias("courses_train"), F.count_distinct(F.when(new, course)).alias("courses_test"),
        F.count_distinct(F.struct(F.col("college"), course)).alias("college_courses"))


@query("d17_distinct_by_year", """
WITH e AS (SELECT (strm // 10)::BIGINT AS year, student, instructor FROM enrolment_v), l AS (SELECT year, 'student' AS variable, student AS id FROM e UNION ALL SELECT year, 'instructor', instructor FROM e)
SELECT year, variable, count(DISTINCT id) AS n FROM l GROUP BY GROUPING SETS ((year, variable), (variable))
""")
def distinct_by_year(r):
    """Students and instructors by year and in all, from one set of stored bitmaps."""
    from cohortlens.operators.bitmaps import distinct_counts, distinct_parts
    from cohortlens.sources.scan import sink, work_folder

    rows = r.enrolment.withColumn("year", F.floor(F.col("strm") / 10))
    parts = sink(distinct_parts(rows, "year", ["student", "instructor"]), work_folder(r.spark))
    total = distinct_counts(parts).withColumn("year", F.lit(None).cast("bigint"))
    return distinct_counts(parts, "year").unionByName(total)


@query("d18_rate_by", """
SELECT 'all' AS part, avg(y) AS rate, count(*) AS n FROM scores_v UNION ALL SELECT CASE valid WHEN 0 THEN 'train' ELSE 'test' END, avg(y), count(*) FROM scores_v GROUP BY valid
""")
def rate_by(r):
    part = F.when(F.grouping("valid") == 1, "all").when(F.col("valid") == 0, "train").otherwise("test")
    return r.scores.cube("valid").agg(part.alias("part"), F.avg("y").alias("rate"), F.count(F.lit(1)).alias("n")).drop("valid")


@query("d19_freq", "SELECT deglvl, dual_enrollment, count(*) AS n FROM snapshot_v GROUP BY ALL")
def freq(r):
    return a.freq(r.snapshots, ["deglvl", "dual_enrollment"])


@query("d20_section_size", """
SELECT student, strm, college, subject, course_num, section, count(*) OVER (PARTITION BY strm, college, subject, course_num, section) AS size FROM enrolment_v
""")
def section_size(r):
    from cohortlens.plans.courses import section_size as size

    return size(r.enrolment).select("student", "strm", "college", "subject", "course_num", "section", "size")


@query("d21_max_low_missing", """
SELECT student, college, CASE WHEN round(m,2) <> 0.01 THEN m END AS intensity FROM (SELECT student, college, max(coalesce(intensity, 0.01)) AS m FROM spells_v GROUP BY ALL)
""")
def max_low_missing(r):
    return a.collapse(r.spells, ["student", "college"], intensity=a.max_low_missing(F.col("intensity")))


@query("d22_pell_flag", f"""
WITH {AID_TERMS}, s AS (SELECT student, year, term, budget, sum(CASE WHEN pell=0 AND budget IS NULL THEN NULL ELSE pell END) AS pell, sum(grants) AS grants FROM t GROUP BY ALL),
f AS (SELECT *, CASE WHEN budget IS NULL AND coalesce(pell,0)=0 THEN NULL ELSE (coalesce(pell,0)>0)::INT END AS flag FROM s)
SELECT student, (10*(year-1800)+term)::INT AS strm, max(flag) AS pell, sum(grants) AS grants FROM f GROUP BY ALL
""")
def pell_flag(r):
    return term_aid(r.aid)


@query("d23_reconcile_max", "SELECT source, max(dual_enrollment) OVER (PARTITION BY zcta) AS dual_enrollment, max(fhe) OVER (PARTITION BY zcta) AS fhe FROM snapshot_v")
def reconcile_max(r):
    return a.reconcile_max(r.snapshots.select("source", "zcta", "dual_enrollment", "fhe"), "zcta", ["dual_enrollment", "fhe"]).drop("zcta")
