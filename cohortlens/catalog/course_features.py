"""Composite course-level and term-level feature jobs."""

from pyspark.sql import functions as F

from cohortlens.catalog.registry import ORACLE, query
from cohortlens.catalog.scalars import SUBJECT_SQL
from cohortlens.catalog.windows import trend_ctes
from cohortlens.functions.codes import CLUSTERS
from cohortlens.functions.nulls import zero
from cohortlens.operators.reshape import calendar
from cohortlens.plans import courses as c
from cohortlens.plans import terms as t
from cohortlens.sources.scan import work_folder

FILLED = """
n1 AS (SELECT * REPLACE (CASE WHEN regexp_full_match(course_num,'[0-9]{3}L') THEN substr(course_num,1,3) ELSE course_num END AS course_num) FROM enrolment_v),
n2 AS (SELECT *, min(grade) OVER w AS lo, max(grade) OVER w AS hi, count(*) OVER w AS nobs FROM n1 WINDOW w AS (PARTITION BY student, college, strm, subject, course_num)),
n3 AS (SELECT * EXCLUDE (grade, lo, hi), coalesce(grade, CASE WHEN lo=hi THEN lo END) AS grade FROM n2),
n4 AS (SELECT * EXCLUDE (nobs) FROM n3 WHERE NOT (credit=0 AND nobs=1 AND grade IS NULL)),
n5 AS (SELECT *, min(grade) OVER w AS lo, max(grade) OVER w AS hi FROM n4 WINDOW w AS (PARTITION BY student, strm, subject, course_num)),
filled AS (SELECT * EXCLUDE (grade, lo, hi), subject || '_' || course_num AS course, coalesce(grade, CASE WHEN lo=hi THEN lo END) AS grade FROM n5)"""
PTS = "CASE grade WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 ELSE 0 END"
W = "CASE WHEN grade IN ('A','B','C','D','F') THEN credit ELSE 0 END"
ADJ = "CASE WHEN grade='W' THEN credit/3 ELSE credit END"
ATTEMPT = "coalesce(grade,'') NOT IN ('W','X','XN')"
EARN = "coalesce(grade,'') IN ('A','B','C','D','S','P','N','*','')"


def keyed(r):
    return c.with_course(r.enrolment)


@query("l01_eligible_enrolments", """
SELECT student, strm, college, course, section, min(grade) AS grade, sum(credit) AS credit FROM (
 SELECT DISTINCT student, strm, college, subject || '_' || course_num AS course, section, credit, grade FROM enrolment_v WHERE credit <> 0 AND grade IS NOT NULL) GROUP BY ALL
""")
def eligible_enrolments(r):
    return c.eligible_enrolments(r.enrolment)


@query("l17_course_records", f"""
WITH {FILLED}, x AS (SELECT *, {PTS} AS pts, {W} AS eff, CASE WHEN regexp_full_match(course_num,'[0-9]{{3}}|[0-9]{{3}}L|[0-9]{{4}}L') THEN {W} ELSE 0 END AS eff2,
  {ADJ} AS adj, CASE WHEN grade='W' THEN 0 ELSE credit END AS new,
  row_number() OVER (PARTITION BY student, strm, course ORDER BY credit DESC, {PTS} DESC, md5(concat_ws('#', student, strm, subject, course_num, college, section, '1234'))) AS rn FROM filled),
g AS (SELECT student, strm, subject, course_num, course, max(CASE WHEN rn=1 THEN college END) AS college, sum(eff*pts)/nullif(sum(eff),0) AS est_grade, sum(new) AS credit, sum(adj) AS adj_credit,
  sum(eff2) AS gpa_credit, sum(eff2*pts) AS gpa_points, min((coalesce(grade,'')='W')::INT) AS withdrawn FROM x GROUP BY ALL),
p AS (SELECT student, strm, sum(CASE WHEN regexp_full_match(course_num,'[1-9][0-9]{{2}}') AND coalesce(grade,'') NOT IN ('F','I','R','U','W','X','XN','XY') THEN credit ELSE 0 END) AS earned,
  sum(CASE WHEN regexp_full_match(course_num,'[1-9][0-9]{{2}}') THEN credit ELSE 0 END) AS attempted FROM filled GROUP BY ALL),
q AS (SELECT student, strm, coalesce(sum(earned) OVER (PARTITION BY student ORDER BY strm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS cum_earned,
  coalesce(lag(attempted) OVER (PARTITION BY student ORDER BY strm) - lag(earned) OVER (PARTITION BY student ORDER BY strm),0) AS extra FROM p)
SELECT g.*, sum(adj_credit) OVER (PARTITION BY g.student, g.strm) AS term_credits_attempted, cum_earned, cum_earned + extra AS cum_expected FROM g LEFT JOIN q USING (student, strm)
""")
def course_records(r):
    return c.course_records(r.enrolment)


@query("l18_section_predictors", f"""
WITH {FILLED}, d AS (SELECT student, strm, college, course, course_num, section, max(day_eve_code) AS code FROM filled WHERE credit<>0 AND regexp_full_match(course_num,'[1-9][0-9]{{2}}') GROUP BY ALL)
SELECT student, strm, college, course, section, count(*) OVER (PARTITION BY strm, college, course, section) AS size, (code='E')::INT AS eve_ind, (code='O')::INT AS online_ind,
 (course_num LIKE '2%')::INT AS lvl2_ind FROM d
""")
def section_predictors(r):
    return c.section_predictors(r.enrolment, r.dealt)


@query("l19_dual_enrolment", """
WITH tm AS (SELECT DISTINCT student, strm FROM enrolment_v), d AS (SELECT student, strm, max(dual_enrollment) AS dual FROM snapshot_v GROUP BY ALL),
b AS (SELECT coalesce(d.student, tm.student) AS student, coalesce(d.strm, tm.strm) AS strm, coalesce(dual,0) AS dual_ind FROM d FULL JOIN tm ON d.student=tm.student AND d.strm=tm.strm)
SELECT * FROM (SELECT student, strm, dual_ind, coalesce(max(dual_ind) OVER (PARTITION BY student ORDER BY strm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS ever_dual FROM b) SEMI JOIN tm USING (student, strm)
""")
def dual_enrolment(r):
    return t.dual_enrolment(r.snapshots, r.enrolment.select("student", "strm").distinct())


@query("l20_demographic_flags", """
WITH s AS (SELECT student, source, strm, source % 8 AS race, CASE WHEN source % 2=0 THEN 'M' ELSE 'F' END AS gender, 18 + source % 30 AS age, strm // 20 AS snap FROM snapshot_v),
l AS (SELECT * FROM s WHERE snap = (SELECT max(snap) FROM s s2 WHERE s2.student=s.student)), k AS (SELECT *, CASE WHEN race IN (0,7) THEN NULL ELSE race END AS rc FROM l),
c AS (SELECT student, rc, count(*) AS n FROM k WHERE rc IS NOT NULL GROUP BY ALL), top AS (SELECT student, count(*) AS ties, min(rc) AS lo FROM c WHERE n=(SELECT max(n) FROM c c2 WHERE c2.student=c.student) GROUP BY student),
gc AS (SELECT student, gender, count(*) AS n FROM k GROUP BY ALL), gt AS (SELECT student, count(*) AS ties, min(gender) AS lo FROM gc WHERE n=(SELECT max(n) FROM gc g2 WHERE g2.student=gc.student) GROUP BY student),
u AS (SELECT student, min((rc IS NULL)::INT) AS allmiss, max((rc IS NULL)::INT) AS anymiss, min(age) AS age FROM k GROUP BY student),
f AS (SELECT u.student, u.age, CASE WHEN top.ties=1 THEN top.lo WHEN u.allmiss=0 THEN 8 END AS race, CASE WHEN gt.ties=1 THEN gt.lo END AS gender FROM u LEFT JOIN top USING (student) LEFT JOIN gt USING (student))
SELECT student, age, (coalesce(gender,'')='M')::INT AS male, coalesce((race=1)::INT,0) AS white, coalesce((race=2)::INT,0) AS afam, coalesce((race=3)::INT,0) AS hisp, coalesce((race=4)::INT,0) AS asian, coalesce((race IN (5,6,8))::INT,0) AS other FROM f
""")
def demographic_flags(r):
    from cohortlens.plans.students import demographic_flags as flags

    k = F.col("source")
    s = r.snapshots.select("student", F.floor(F.col("strm") / 20).alias("source"), (k % 8).alias("race"),
                           F.when(k % 2 == 0, "M").otherwise("F").alias("gender"), (18 + k % 30).alias("age"))
    return flags(s)


SECTIONS_SQL = "SELECT DISTINCT strm, college, subject || '_' || course_num AS course, section, instructor % 2 AS faculty_code, instructor FROM enrolment_v"


def _sections(r):
    return keyed(r).select("strm", "college", "course", "section", (F.col("instructor") % 2).alias("faculty_code"), "instructor").distinct()


@query("l21_instructor_table", f"""
WITH s AS ({SECTIONS_SQL}), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strm, college, course, section ORDER BY faculty_code, instructor) AS rn FROM s) WHERE rn=1),
f AS (SELECT instructor, college, min(strm) AS first_strm FROM s GROUP BY ALL)
SELECT o.strm, o.college, o.course, o.section, o.instructor, (faculty_code=1)::INT AS full_time, (o.strm - first_strm >= 60)::INT AS tenure FROM o JOIN f USING (instructor, college)
""")
def instructor_table(r):
    full_time, tenure = c.instructor_table(_sections(r))
    return tenure.join(full_time, ["strm", "college", "course", "section"])


@query("l22_past_average_grade", f"""
WITH {FILLED}, e AS (SELECT student, strm, course, sum({W}*{PTS})/sum({W}) AS est FROM filled GROUP BY ALL HAVING sum({W}) > 0),
cl AS (SELECT strm, college, course, avg(est) AS avg_grade FROM (SELECT DISTINCT student, strm, college, course FROM filled) JOIN e USING (student, strm, course) GROUP BY ALL),
s AS (SELECT DISTINCT instructor, college, course, strm, section FROM ({SECTIONS_SQL})), tg AS (SELECT DISTINCT instructor, college, course, strm FROM s)
SELECT tg.instructor, tg.college, tg.course, tg.strm, (avg(cl.avg_grade) IS NOT NULL)::INT AS has_past_avg_grade, coalesce(avg(cl.avg_grade),0) AS past_avg_grade
FROM tg LEFT JOIN s ON s.instructor=tg.instructor AND s.college=tg.college AND s.course=tg.course AND s.strm < tg.strm LEFT JOIN cl ON cl.strm=s.strm AND cl.college=s.college AND cl.course=s.course GROUP BY ALL
""")
def past_average_grade(r):
    return c.past_average_grade(r.enrolment, _sections(r), r.dealt)


HISTORY = f"""
per AS (SELECT student, strm, sum(credit) AS al, sum(CASE WHEN grade='W' THEN credit ELSE 0 END) AS wd, sum(CASE WHEN grade IN ('I','R') THEN credit ELSE 0 END) AS inc,
  sum(CASE WHEN length(course_num)<3 THEN credit ELSE 0 END) AS dev, sum(CASE WHEN {EARN} THEN credit ELSE 0 END) AS earned, sum(CASE WHEN {ATTEMPT} THEN credit ELSE 0 END) AS att FROM enrolment_v GROUP BY ALL),
hist AS (SELECT student, strm, row_number() OVER (PARTITION BY student ORDER BY strm) - 1 AS prior_terms, sum(wd) OVER v/nullif(sum(al) OVER v,0) AS pct_withdrawn, sum(inc) OVER v/nullif(sum(al) OVER v,0) AS pct_incomplete,
  sum(dev) OVER v/nullif(sum(al) OVER v,0) AS pct_dev, sum(earned) OVER v/nullif(sum(att) OVER v,0) AS overall_prop_comp, stddev_samp(earned/nullif(att,0)) OVER v AS prop_comp_sd,
  min(strm) OVER (PARTITION BY student) AS first, count(*) FILTER (WHERE strm%10<>3) OVER v AS attended FROM per WINDOW v AS (PARTITION BY student ORDER BY strm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
th AS (SELECT student, strm, prior_terms, pct_withdrawn, pct_incomplete, pct_dev, overall_prop_comp, prop_comp_sd, coalesce((possible-attended)/nullif(possible,0)::DOUBLE,0) AS pct_stopped FROM (
  SELECT *, (SELECT count(*) FROM (SELECT unnest(range(1900,2100)) AS c) WHERE c%10 IN (2,4) AND c >= hist.first AND c < hist.strm) AS possible FROM hist))"""


@query("l23_term_history", f"WITH {HISTORY} SELECT * FROM th")
def term_history(r):
    return t.term_history(r.enrolment)


GPA = f"""gi AS (SELECT student, strm, sum({ADJ}) * CASE WHEN strm%10=3 THEN 1.5::DOUBLE ELSE 1 END AS credits, sum({W}*{PTS})/nullif(sum({W}),0) AS term_gpa FROM enrolment_v GROUP BY student, strm),
gl AS (SELECT student, strm, credits AS crnt_enrl_intensity, lag(credits) OVER v AS e1, lag(term_gpa) OVER v AS g1, lag(term_gpa,2) OVER v AS g2 FROM gi WINDOW v AS (PARTITION BY student ORDER BY strm)),
lags AS (SELECT student, strm, crnt_enrl_intensity, coalesce(e1,0) AS enrl_intensity, coalesce(g1,0) AS term_gpa_1, coalesce(g2,0) AS term_gpa_2, (e1 IS NOT NULL)::INT AS has_enrl_intensity,
 (g1 IS NOT NULL)::INT AS has_term_gpa_1, (g2 IS NOT NULL)::INT AS has_term_gpa_2 FROM gl)"""


@query("l24_gpa_intensity_lags", f"WITH {GPA} SELECT * FROM lags")
def gpa_intensity_lags(r):
    return t.gpa_intensity_lags(t.term_gpa_intensity(r.enrolment))


TRENDS = f"{trend_ctes('gi', 'term_gpa', 'a_')}, {trend_ctes('gi', 'credits', 'b_')}"


@query("l25_trends", f"WITH {GPA}, {TRENDS} SELECT student, strm, a.trend AS gpa_trend, b.trend AS intensity_trend FROM a_trend a JOIN b_trend b USING (student, strm)")
def trends(r):
    return t.trends(t.term_gpa_intensity(r.enrolment))


TRAIL = f"""
tm AS (SELECT DISTINCT strm FROM snapshot_v), fi AS (SELECT college, course, tm.strm, sum({W}*{PTS})/sum({W}) AS avg_grade FROM filled f JOIN tm ON f.strm < tm.strm AND f.strm >= tm.strm-50 WHERE {W} > 0 GROUP BY ALL),
co AS (SELECT college, tm.strm, sum({W}*{PTS})/sum({W}) AS avg_grade_2 FROM filled f JOIN tm ON f.strm < tm.strm AND f.strm >= tm.strm-50 WHERE {W} > 0 GROUP BY ALL)"""


@query("l26_trailing_average_grades", f"WITH {FILLED}, {TRAIL} SELECT fi.*, co.avg_grade_2 FROM fi JOIN co USING (college, strm)")
def trailing_average_grades(r):
    fine, coarse = c.trailing_grades(c.graded(c.with_course(c.fill_grades(r.enrolment))), calendar(r.snapshots, "strm"))
    return fine.join(coarse, ["college", "strm"])


@query("l27_prerequisite_and_repeat", f"""
WITH el AS (SELECT DISTINCT student, strm, college, subject || '_' || course_num AS course, section FROM enrolment_v WHERE credit<>0 AND grade IS NOT NULL),
h AS (SELECT student, strm, subject || '_' || course_num AS course, sum({W}) AS w, sum({W}*{PTS}) AS wp FROM enrolment_v WHERE {W} > 0 GROUP BY ALL),
pr AS (SELECT el.student, el.strm, el.college, el.course, el.section, sum(h.wp)/sum(h.w) AS g FROM el JOIN prereq_v p ON p.course=el.course JOIN h ON h.student=el.student AND h.course=p.prereq AND h.strm<el.strm GROUP BY ALL),
re AS (SELECT el.student, el.strm, el.college, el.course, el.section, sum(h.wp)/sum(h.w) AS g FROM el JOIN h ON h.student=el.student AND h.course=el.course AND h.strm<el.strm GROUP BY ALL)
SELECT el.*, (pr.g IS NOT NULL)::INT AS has_prereq_grade, coalesce(pr.g,0) AS prereq_grade, (re.g IS NOT NULL)::INT AS has_repeat_grade, coalesce(re.g,0) AS repeat_grade
FROM el LEFT JOIN pr USING (student, strm, college, course, section) LEFT JOIN re USING (student, strm, college, course, section)
""")
def prerequisite_and_repeat(r):
    target = c.eligible_enrolments(r.enrolment).select(*c.SECTION)
    history = c.graded(keyed(r)).where("w > 0")
    return c.prior_grades(target, history, r.prerequisites)


@query("l28_concurrent_difficulty", f"""
WITH f AS (SELECT *, subject || '_' || course_num AS course FROM enrolment_v), filled AS (SELECT * FROM f), {TRAIL},
b AS (SELECT student, strm, college, course, sum(credit) AS credit FROM f WHERE credit > 0 GROUP BY ALL),
a AS (SELECT b.*, coalesce(fi.avg_grade, co.avg_grade_2, 0) AS g FROM b LEFT JOIN fi USING (strm, college, course) LEFT JOIN co USING (strm, college)),
o AS (SELECT *, (sum(g*credit) OVER v - g*credit)/nullif(sum(credit) OVER v - credit,0) AS x FROM a WINDOW v AS (PARTITION BY student, strm))
SELECT student, strm, college, course, (x IS NOT NULL)::INT AS has_avg_g_concurrent, coalesce(x,0) AS avg_g_concurrent FROM o
""")
def concurrent_difficulty(r):
    return c.concurrent_difficulty(keyed(r), calendar(r.snapshots, "strm"))


CLUSTER = f"""
el AS (SELECT DISTINCT student, strm, college, subject, subject || '_' || course_num AS course, section FROM enrolment_v WHERE grade IN ('A','B','C','D','F','W') AND length(subject || '_' || course_num) = 7),
h AS (SELECT student, strm, {SUBJECT_SQL} AS k, sum({W}) AS w, sum({W}*{PTS}) AS wp FROM enrolment_v WHERE {W} > 0 GROUP BY ALL),
ct AS (SELECT s.student, s.strm, {', '.join(f"sum(CASE WHEN k='{x}' THEN wp END)/sum(CASE WHEN k='{x}' THEN w END) AS g_{x}" for x in CLUSTERS)} FROM (SELECT DISTINCT student, strm FROM el) s LEFT JOIN h ON h.student=s.student AND h.strm<s.strm GROUP BY ALL),
cc AS (SELECT el.*, {SUBJECT_SQL} AS cluster, {', '.join(f'(g_{x} IS NOT NULL)::INT AS {x}, coalesce(g_{x},0) AS {x}_grade' for x in CLUSTERS)} FROM el JOIN ct USING (student, strm))"""


def _cluster_target(r):
    from cohortlens.functions.grades import OUTCOME

    rows = keyed(r).where(F.col("grade").isin(OUTCOME)).where(F.length("course") == 7)
    return rows.select("student", "strm", "college", "subject", "course", "section").distinct()


@query("l29_cluster_history", f"WITH {CLUSTER} SELECT * FROM cc")
def cluster_history(r):
    return c.cluster_totals(_cluster_target(r), c.graded(r.enrolment).where("w > 0"))


@query("l29_cluster_pairs", f"WITH {CLUSTER} SELECT strm, " + ", ".join(
    f"sum(CASE WHEN cluster='{y}' THEN {x} ELSE 0 END)::BIGINT AS {x}_{y}, max(CASE WHEN cluster='{y}' THEN {x}_grade ELSE 0 END) AS {x}_{y}_grade" for x in CLUSTERS for y in CLUSTERS) + " FROM cc GROUP BY strm")
def cluster_pairs(r):
    wide = c.cluster_history(_cluster_target(r), c.graded(r.enrolment).where("w > 0"))
    pairs = [f"{x}_{y}" for x in CLUSTERS for y in CLUSTERS]
    return wide.groupBy("strm").agg(*[F.sum(p).alias(p) for p in pairs], *[F.max(f"{p}_grade").alias(f"{p}_grade") for p in pairs])


PRIOR_GPA = f"""
kn AS (SELECT student, strm, max(distance)/25 AS cum_gpa FROM snapshot_v GROUP BY ALL),
pg AS (SELECT student, strm, sum({W}) AS w, sum({W}*{PTS}) AS wp FROM enrolment_v GROUP BY ALL),
pc AS (SELECT student, strm, sum(wp) OVER v/nullif(sum(w) OVER v,0) AS so_far FROM pg WINDOW v AS (PARTITION BY student ORDER BY strm)),
pp AS (SELECT student, strm, last_value(so_far IGNORE NULLS) OVER (PARTITION BY student ORDER BY strm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM pc),
cg AS (SELECT pp.student, pp.strm, coalesce(kn.cum_gpa, prior) AS cum_gpa FROM pp LEFT JOIN kn USING (student, strm))"""


def _known_gpa(r):
    return r.snapshots.groupBy("student", "strm").agg((F.max("distance") / 25).alias("cum_gpa"))


@query("l11_prior_cumulative_gpa", f"WITH {PRIOR_GPA} SELECT * FROM cg")
def prior_cumulative_gpa(r):
    return t.prior_cumulative_gpa(r.enrolment, _known_gpa(r))


IMPUTED = ["cum_gpa", "overall_prop_comp", "prop_comp_sd"]
BLOCKS = ["pct_stopped", "pct_withdrawn", "cum_gpa", "overall_prop_comp", "prop_comp_sd", "enrl_intensity", "term_gpa_1", "ever_dual"]


@query("l30_term_predictors", f"""
WITH {PRIOR_GPA}, {HISTORY}, {GPA}, b AS (SELECT coalesce(d.student, tm.student) AS student, coalesce(d.strm, tm.strm) AS strm, coalesce(dual,0) AS dual_ind FROM (SELECT student, strm, max(dual_enrollment) AS dual FROM snapshot_v GROUP BY ALL) d
  FULL JOIN (SELECT DISTINCT student, strm FROM enrolment_v) tm ON d.student=tm.student AND d.strm=tm.strm),
du AS (SELECT student, strm, coalesce(max(dual_ind) OVER (PARTITION BY student ORDER BY strm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS ever_dual FROM b),
j AS (SELECT th.*, cg.cum_gpa, enrl_intensity, term_gpa_1, ever_dual, (strm = min(strm) OVER (PARTITION BY student))::INT AS first_ind FROM th JOIN cg USING (student, strm) JOIN lags USING (student, strm) JOIN du USING (student, strm)),
m AS (SELECT {', '.join(f'avg({x}) AS m_{x}' for x in IMPUTED)} FROM j WHERE first_ind=0 AND strm<2000)
SELECT student, strm, first_ind, {', '.join(f"coalesce({x}, CASE WHEN first_ind=1 THEN 0 ELSE {'m_' + x if x in IMPUTED else 'NULL'} END) AS {x}" for x in BLOCKS)} FROM j, m
""")
def term_predictors(r):
    e = r.enrolment
    terms = e.select("student", "strm").distinct()
    keys = ["student", "strm"]
    history = t.term_history(e).select(*keys, "pct_stopped", "pct_withdrawn", "overall_prop_comp", "prop_comp_sd")
    lags = t.gpa_intensity_lags(t.term_gpa_intensity(e)).select(*keys, "enrl_intensity", "term_gpa_1")
    dual = t.dual_enrolment(r.snapshots, terms).select(*keys, "ever_dual")
    gpa = t.prior_cumulative_gpa(e, _known_gpa(r))
    return t.term_predictors(terms, [history, gpa, lags, dual], IMPUTED, 2000).select(*keys, "first_ind", *BLOCKS)


@query("l31_term_shares", """
WITH x AS (SELECT DISTINCT student, strm, college, subject, course_num, credit, day_eve_code FROM enrolment_v WHERE credit<>0),
k AS (SELECT student, strm, college, subject, course_num, day_eve_code, count(*) AS n FROM x GROUP BY ALL), m AS (SELECT student, strm, college, subject, course_num, max(day_eve_code) AS code FROM (SELECT *, max(n) OVER (PARTITION BY student, strm, college, subject, course_num) AS mx FROM k) WHERE n=mx GROUP BY ALL),
s AS (SELECT student, strm, college, subject, course_num, sum(credit) AS credit FROM x GROUP BY ALL)
SELECT student, strm, max((length(course_num)<3)::INT) AS dev, sum(CASE WHEN length(course_num)=3 AND course_num LIKE '2%' THEN credit ELSE 0 END)/sum(credit) AS lvl2_share,
 sum(CASE WHEN code='E' THEN credit ELSE 0 END)/sum(credit) AS eve_share, sum(CASE WHEN code='O' THEN credit ELSE 0 END)/sum(credit) AS online_share FROM s JOIN m USING (student, strm, college, subject, course_num) GROUP BY student, strm
""")
def term_shares(r):
    return c.term_shares(r.enrolment)


COLLEGES = [f"NATION_{i}" for i in range(25)]


@query("l32_training_rows", f"""
WITH {FILLED}, el AS (SELECT student, strm, college, subject || '_' || course_num AS course, section, min(grade) AS grade FROM enrolment_v WHERE credit<>0 AND grade IS NOT NULL GROUP BY ALL),
d AS (SELECT student, strm, college, course, course_num, section, max(day_eve_code) AS code FROM filled WHERE credit<>0 AND regexp_full_match(course_num,'[1-9][0-9]{{2}}') GROUP BY ALL),
sp AS (SELECT student, strm, college, course, section, count(*) OVER (PARTITION BY strm, college, course, section) AS size, (code='E')::INT AS eve_ind, (code='O')::INT AS online_ind, (course_num LIKE '2%')::INT AS lvl2_ind FROM d),
h AS (SELECT student, strm, subject || '_' || course_num AS course, sum({W}) AS w, sum({W}*{PTS}) AS wp FROM enrolment_v WHERE {W} > 0 GROUP BY ALL),
re AS (SELECT el.student, el.strm, el.college, el.course, el.section, sum(h.wp)/sum(h.w) AS g FROM el JOIN h ON h.student=el.student AND h.course=el.course AND h.strm<el.strm GROUP BY ALL)
SELECT el.student, el.strm, el.college, el.course, el.section, (grade IN ('A','B','C'))::INT AS passed, size, eve_ind, online_ind, lvl2_ind, (re.g IS NOT NULL)::INT AS has_repeat_grade, coalesce(re.g,0) AS repeat_grade,
 {', '.join(f"(el.college='{n}')::INT AS college_{n.lower()}" for n in COLLEGES[1:])}, (el.strm>=2000)::INT AS valid
FROM el JOIN sp USING (student, strm, college, course, section) LEFT JOIN re USING (student, strm, college, course, section)
""")
def training_rows(r):
    r = r.by_student()
    e = r.enrolment
    eligible = c.eligible_enrolments(e)
    repeats = c.repeat_grades(eligible.select(*c.SECTION), c.graded(keyed(r)).where("w > 0"))
    return c.training_rows(eligible, [c.section_predictors(e, r.dealt), repeats], COLLEGES, COLLEGES[0], 2000)


PAIRS = [(x, y) for x in CLUSTERS for y in CLUSTERS]
PROGRAM = """SELECT student, strm, max(source % 9)::BIGINT AS cip, max(CASE deglvl WHEN 'AA&S' THEN 0 WHEN 'AAS' THEN 1 WHEN 'CERT' THEN 2 WHEN 'CSC' THEN 3 ELSE 4 END) AS degree_level
  FROM snapshot_v GROUP BY student, strm"""
TERM_COLUMNS = ["first_ind", *BLOCKS]
CIPS, DEGREES = range(1, 9), range(4)


def _program(r):
    """Program code (0 for none) and credential level (4 for none) of each student-term."""
    level = F.coalesce(*[F.when(F.col("deglvl") == v, i) for i, v in enumerate(["AA&S", "AAS", "CERT", "CSC"])], F.lit(4))
    return r.snapshots.groupBy("student", "strm").agg(F.max(F.col("source") % 9).alias("cip"), F.max(level).alias("degree_level"))


def training(r, least_share=0.0):
    """The course-level training table of all four blocks, its level dictionary and the report of its assembly."""
    r = r.by_student()
    e = r.enrolment
    eligible = c.eligible_enrolments(e)
    pairs = c.cluster_totals(_cluster_target(r), c.graded(e).where("w > 0")).drop("subject")
    terms = term_predictors(r).select("student", "strm", *[zero(F.col(x)).alias(x) for x in TERM_COLUMNS]).join(_program(r), ["student", "strm"])
    courses = section_predictors(r).join(prerequisite_and_repeat(r), c.SECTION)
    blocks = {"course": (courses, c.SECTION), "concurrent": (concurrent_difficulty(r), ["student", "strm", "college", "course"]),
              "term": (terms, ["student", "strm"]), "cluster": (pairs, c.SECTION),
              "instructor": (c.instructor_block(_sections(r), past_average_grade(r)), ["strm", "college", "course", "section"])}
    return c.training_table(eligible, blocks, COLLEGES, {"cip": 0, "degree_level": 4}, 2000, work_folder(r.spark), least_share)


@query("l32_training_table", f"""
WITH el AS ({ORACLE['l01_eligible_enrolments']}), sp AS ({ORACLE['l18_section_predictors']}), pg AS ({ORACLE['l27_prerequisite_and_repeat']}),
cd AS ({ORACLE['l28_concurrent_difficulty']}), tp AS ({ORACLE['l30_term_predictors']}), cl AS ({ORACLE['l29_cluster_history']}), it AS ({ORACLE['l21_instructor_table']}),
pa AS ({ORACLE['l22_past_average_grade']}), pr AS ({PROGRAM})
SELECT student, strm, college, course, section, (el.grade IN ('A','B','C'))::INT AS passed, sp.size, sp.eve_ind, sp.online_ind, sp.lvl2_ind, has_prereq_grade, prereq_grade, has_repeat_grade, repeat_grade,
 has_avg_g_concurrent, avg_g_concurrent, {', '.join(f'coalesce({x}, 0) AS {x}' for x in TERM_COLUMNS)},
 {', '.join(f"CASE WHEN cluster='{y}' THEN {x} ELSE 0 END AS {x}_{y}, CASE WHEN cluster='{y}' THEN {x}_grade ELSE 0 END AS {x}_{y}_grade" for x, y in PAIRS)},
 full_time, tenure, coalesce(has_past_avg_grade, 0) AS has_past_avg_grade, coalesce(past_avg_grade, 0) AS past_avg_grade,
 {', '.join(f"(college='{n}')::INT AS college_{n.lower()}" for n in COLLEGES[1:])}, {', '.join(f"(cip={k})::INT AS cip_{k}" for k in CIPS)},
 {', '.join(f"(degree_level={k})::INT AS degree_level_{k}" for k in DEGREES)}, (strm>=2000)::INT AS valid
FROM el JOIN sp USING (student, strm, college, course, section) JOIN pg USING (student, strm, college, course, section) JOIN cd USING (student, strm, college, course)
JOIN tp USING (student, strm) JOIN pr USING (student, strm) JOIN (SELECT * EXCLUDE (subject) FROM cl) cl USING (student, strm, college, course, section)
JOIN it USING (strm, college, course, section) LEFT JOIN pa USING (instructor, college, course, strm)
""")
def training_table(r):
    return training(r)[0]


@query("l32_level_dictionary", f"""
WITH x AS (SELECT college, cip::VARCHAR AS cip, degree_level::VARCHAR AS degree_level FROM ({ORACLE['l01_eligible_enrolments']}) JOIN ({PROGRAM}) USING (student, strm)),
n AS (SELECT 'college' AS variable, college AS level, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 'cip', cip, count(*) FROM x GROUP BY ALL
  UNION ALL SELECT 'degree_level', degree_level, count(*) FROM x GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY variable)::DOUBLE AS share FROM n)
SELECT variable, level, n, share, CASE WHEN (variable, level) IN (('college', 'NATION_0'), ('cip', '0'), ('degree_level', '4')) THEN NULL
 WHEN share < 0.05 THEN variable || '_rare' ELSE variable || '_' || lower(level) END AS "column" FROM s
""")
def level_dictionary(r):
    from cohortlens.operators.levels import fit_levels

    rows = c.eligible_enrolments(r.enrolment).join(_program(r), ["student", "strm"])
    return fit_levels(rows, {"college": COLLEGES[0], "cip": 0, "degree_level": 4}, 0.05)
