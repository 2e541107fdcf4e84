"""Join operators."""

from pyspark.sql import functions as F

from cohortlens.catalog.registry import query
from cohortlens.operators import joins as j
from cohortlens.operators.reshape import calendar
from cohortlens.plans.courses import graded, trailing_grades


@query("c01_inner_join", """
SELECT e.student, e.strm, e.section, e.college, e.subject, e.course_num, v.grp FROM enrolment_v e JOIN student_v v USING (student)
""")
def inner(r):
    e = r.enrolment.select("student", "strm", "section", "college", "subject", "course_num")
    return j.join(e, r.students.select("student", "grp"), "student", expect="m:1")


YEAR_BEFORE = "(SELECT student, year + 1 AS year, credfal FROM aid_v)"


def _year_before(r):
    """Aid under the year after it, so that a row of a year finds that of the year before, if there was any."""
    return r.aid.select("student", (F.col("year") + 1).alias("year"), "credfal")


def _years(r):
    return r.aid.select("student", "year", "credspr")


@query("c02_left_join", f"""
SELECT a.student, a.year, a.credspr::BIGINT AS credspr, b.credfal::BIGINT AS credfal FROM aid_v a LEFT JOIN {YEAR_BEFORE} b USING (student, year)
""")
def left(r):
    return j.join(_years(r), _year_before(r), ["student", "year"], "left")


@query("c03_right_join", f"""
SELECT a.student, a.year, a.credspr::BIGINT AS credspr, b.credfal::BIGINT AS credfal FROM {YEAR_BEFORE} b RIGHT JOIN aid_v a USING (student, year)
""")
def right(r):
    return j.join(_year_before(r), _years(r), ["student", "year"], "right")


MERGE = """
WITH l AS (SELECT DISTINCT student, strm FROM enrolment_v),
r AS (SELECT DISTINCT student, strm + CASE WHEN source % 13 = 0 THEN 10 ELSE 0 END AS strm FROM snapshot_v)"""


def late_terms(snapshots):
    """Students and terms of all snapshots, some of which stand a year late, so that neither side holds the other."""
    late = F.when(F.col("source") % 13 == 0, 10).otherwise(0)
    return snapshots.select("student", (F.col("strm") + late).alias("strm"))


def _pair(r):
    return r.enrolment.select("student", "strm").distinct(), late_terms(r.snapshots).distinct()


@query("c04_merge_indicator", MERGE + """
SELECT coalesce(l.student, r.student) AS student, coalesce(l.strm, r.strm) AS strm,
 CASE WHEN r.student IS NULL THEN 1 WHEN l.student IS NULL THEN 2 ELSE 3 END AS merge_code FROM l FULL JOIN r ON l.student=r.student AND l.strm=r.strm
""")
def merge_indicator(r):
    return j.merge_indicator(*_pair(r), ["student", "strm"])


@query("c05_anti_join", """
SELECT student, strm, section, college, course FROM (SELECT *, subject || '_' || course_num AS course FROM enrolment_v)
WHERE course NOT IN (SELECT prereq FROM prereq_v WHERE prereq IS NOT NULL)
""")
def anti(r):
    e = r.enrolment.select("student", "strm", "section", "college", F.concat_ws("_", "subject", "course_num").alias("course"))
    return j.exclude(e, r.prerequisites.select(F.col("prereq").alias("course")), "course")


@query("c06_restrict", "SELECT source, student, strm FROM snapshot_v WHERE student IN (SELECT student FROM student_v WHERE grp='afam')")
def restrict(r):
    return j.restrict(r.snapshots.select("source", "student", "strm"), r.students.where("grp = 'afam'"), "student")


@query("c07_exclude_inconsistent", MERGE + """
SELECT * FROM l WHERE student NOT IN (SELECT r.student FROM r WHERE NOT EXISTS (SELECT 1 FROM l l2 WHERE l2.student=r.student AND l2.strm=r.strm))
""")
def exclude_inconsistent(r):
    return j.exclude_inconsistent(*_pair(r), "student", ["student", "strm"])


@query("c08_join_contract", "SELECT s.source, v.gender FROM snapshot_v s LEFT JOIN student_v v USING (student)")
def contract(r):
    joined = j.join(r.snapshots.select("source", "student"), r.students.select("student", "gender"), "student", "left", expect="m:1")
    return joined.drop("student")


TRAILING = """
g AS (SELECT *, subject || '_' || course_num AS course, CASE WHEN grade IN ('A','B','C','D','F') THEN credit ELSE 0 END AS w,
  CASE grade WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 ELSE 0 END AS pts FROM enrolment_v),
terms AS (SELECT DISTINCT strm FROM enrolment_v),
fine AS (SELECT t.strm, g.college, g.course, sum(w*pts)/nullif(sum(w),0) AS avg_grade FROM g JOIN terms t ON g.strm < t.strm AND g.strm >= t.strm-50
  WHERE w > 0 GROUP BY ALL),
coarse AS (SELECT t.strm, g.college, sum(w*pts)/nullif(sum(w),0) AS avg_grade_2 FROM g JOIN terms t ON g.strm < t.strm AND g.strm >= t.strm-50
  WHERE w > 0 GROUP BY ALL)"""


@query("c09_lookup_fallback", f"""
WITH {TRAILING} SELECT e.student, e.strm, e.section, e.college, e.course, coalesce(f.avg_grade, c.avg_grade_2) AS avg_g
FROM g e LEFT JOIN fine f USING (strm, college, course) LEFT JOIN coarse c USING (strm, college)
""")
def lookup_fallback(r):
    e = r.enrolment.withColumn("course", F.concat_ws("_", "subject", "course_num"))
    fine, coarse = trailing_grades(graded(e), calendar(r.snapshots, "strm"))
    base = e.select("student", "strm", "section", "college", "course")
    return j.lookup_fallback(base, fine, ["strm", "college", "course"], coarse, ["strm", "college"], "avg_grade", "avg_grade_2", "avg_g")


CALENDAR = (1990, 2009)
SPELL_TERMS = """
cal AS (SELECT 10*(y-1800)+t AS strm, y, t, CASE t WHEN 2 THEN 1 WHEN 3 THEN 6 ELSE 9 END AS lo, CASE t WHEN 2 THEN 4 WHEN 3 THEN 7 ELSE 12 END AS hi
  FROM (SELECT unnest(range(1990, 2010)) AS y), (SELECT unnest([2,3,4]) AS t)),
st AS (SELECT s.*, c.strm::INT AS strm FROM spells_v s JOIN cal c ON
  (year(begin_date) < c.y OR (year(begin_date) = c.y AND month(begin_date) <= c.hi)) AND (year(end_date) > c.y OR (year(end_date) = c.y AND month(end_date) >= c.lo)))"""


@query("c10_spells_to_terms", f"WITH {SPELL_TERMS} SELECT student, college, strm, count(*) AS spells, max(intensity) AS intensity FROM st GROUP BY ALL")
def spells_to_terms(r):
    return j.spells_to_terms(r.spells, CALENDAR).groupBy("student", "college", "strm").agg(
        F.count(F.lit(1)).alias("spells"), F.max("intensity").alias("intensity"))


@query("c11_history_before", """
WITH t AS (SELECT DISTINCT student, strm FROM snapshot_v)
SELECT t.student, t.strm, sum(e.credit) AS credit_before, sum(CASE WHEN e.student IS NOT NULL THEN 1 END)::BIGINT AS rows_before
FROM t LEFT JOIN enrolment_v e ON e.student=t.student AND e.strm < t.strm GROUP BY ALL
""")
def history_before(r):
    target = r.snapshots.select("student", "strm").distinct()
    return j.totals_before(target, r.enrolment, ["student"], "strm", {"credit_before": "credit"})


@query("c12_prerequisite_join", """
WITH h AS (SELECT student, strm, subject || '_' || course_num AS course, credit, CASE grade WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 ELSE 0 END AS pts
  FROM enrolment_v WHERE grade IN ('A','B','C','D','F') AND credit > 0),
t AS (SELECT DISTINCT student, strm, subject || '_' || course_num AS course FROM enrolment_v)
SELECT t.student, t.strm, t.course, (sum(h.credit) IS NOT NULL)::INT AS has_prereq_grade, coalesce(sum(h.credit*h.pts)/sum(h.credit), 0) AS prereq_grade
FROM t LEFT JOIN prereq_v p ON p.course=t.course LEFT JOIN h ON h.student=t.student AND h.course=p.prereq AND h.strm < t.strm GROUP BY ALL
""")
def prerequisite_join(r):
    from cohortlens.plans.courses import prior_grades

    e = r.enrolment.withColumn("course", F.concat_ws("_", "subject", "course_num"))
    target = e.select("student", "strm", "course").distinct()
    return prior_grades(target, graded(e).where("w > 0"), r.prerequisites).drop("has_repeat_grade", "repeat_grade")


@query("c13_taught_before", """
WITH s AS (SELECT DISTINCT instructor, college, subject || '_' || course_num AS course, strm, section FROM enrolment_v),
t AS (SELECT DISTINCT instructor, college, course, strm FROM s)
SELECT t.instructor, t.college, t.course, t.strm, count(s.section) AS sections_before
FROM t LEFT JOIN s ON s.instructor=t.instructor AND s.college=t.college AND s.course=t.course AND s.strm < t.strm GROUP BY ALL
""")
def taught_before(r):
    keys = ["instructor", "college", "course"]
    s = r.enrolment.withColumn("course", F.concat_ws("_", "subject", "course_num")).select(*keys, "strm", "section").distinct()
    before = j.own_totals_before(s.withColumn("one", F.lit(1)), keys, "strm", {"sections_before": "one"})
    return before.select(*keys, "strm", F.coalesce("sections_before", F.lit(0)).alias("sections_before"))


@query("c14_skeleton", """
SELECT v.student, t.strm, count(s.source) AS n FROM student_v v CROSS JOIN (SELECT DISTINCT strm FROM snapshot_v) t
LEFT JOIN snapshot_v s ON s.student=v.student AND s.strm=t.strm GROUP BY ALL
""")
def skeleton(r):
    facts = r.snapshots.groupBy("student", "strm").agg(F.count("source").alias("n"))
    grid = j.skeleton(r.students.select("student"), calendar(r.snapshots, "strm"))
    return grid.join(facts, ["student", "strm"], "left").na.fill(0, ["n"])


@query("c15_assemble", """
WITH b AS (SELECT student, strm, sum(credit) AS credit FROM enrolment_v GROUP BY ALL),
s AS (SELECT student, strm, max(dual_enrollment) AS dual FROM snapshot_v GROUP BY ALL),
d AS (SELECT student, strm, count(*) AS n_source FROM snapshot_v GROUP BY ALL)
SELECT b.*, s.dual, d.n_source FROM b JOIN s USING (student, strm) JOIN d USING (student, strm)
""")
def assemble(r):
    keys = ["student", "strm"]
    base = r.enrolment.groupBy(*keys).agg(F.sum("credit").alias("credit"))
    dual = r.snapshots.groupBy(*keys).agg(F.max("dual_enrollment").alias("dual"))
    n = r.snapshots.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_source"))
    return j.assemble(base, [dual, n], keys, "inner", complete=True)


@query("c16_assemble_scores", """
SELECT id, score AS pred_1, floor(score*100)/100 AS pred_2, floor(score*10)/10 AS pred_3, valid FROM scores_v
""")
def assemble_scores(r):
    def part(valid):
        s = r.scores.where(F.col("valid") == valid)
        tables = {"1": s, "2": s.withColumn("score", F.floor(F.col("score") * 100) / 100),
                  "3": s.withColumn("score", F.floor(F.col("score") * 10) / 10)}
        return j.assemble_scores(tables).withColumn("valid", F.lit(valid))

    return part(0).unionByName(part(1))


@query("c17_demographics", """
WITH a AS (SELECT student, strm, max(total_credit_hrs) AS hrs FROM snapshot_v GROUP BY ALL), b AS (SELECT DISTINCT student, strm FROM enrolment_v)
SELECT b.student, b.strm, v.grp, v.gender, a.hrs FROM b JOIN student_v v USING (student) LEFT JOIN a USING (student, strm)
""")
def demographics(r):
    hrs = r.snapshots.groupBy("student", "strm").agg(F.max("total_credit_hrs").alias("hrs"))
    base = r.enrolment.select("student", "strm").distinct()
    return base.join(r.students.select("student", "grp", "gender"), "student").join(hrs, ["student", "strm"], "left")
