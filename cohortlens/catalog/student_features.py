"""Composite student-level feature jobs."""

from pyspark.sql import functions as F

from cohortlens.catalog.aggregates import AID_TERMS
from cohortlens.catalog.course_features import ATTEMPT, EARN, FILLED, PTS
from cohortlens.catalog.joins import CALENDAR, SPELL_TERMS
from cohortlens.catalog.registry import query
from cohortlens.catalog.sql_parts import t_sql
from cohortlens.catalog.measures import OLS_SQL
from cohortlens.functions.codes import GROUPS
from cohortlens.functions.nulls import flag
from cohortlens.functions.terms import SLOTS, last_window_term
from cohortlens.operators import aggs as a
from cohortlens.operators.reshape import calendar
from cohortlens.plans import aid as aidjobs
from cohortlens.plans import external as ext
from cohortlens.plans import measures as m
from cohortlens.plans import students as st
from cohortlens.sources.scan import work_folder
from cohortlens.sources.shuffles import deal

KINDS = {"associate": ("AA&S", "AAS"), "certificate": ("CERT",), "diploma": ("CSC",)}


def records(r):
    """Term rows with graduation and outside-enrolment flags derived from the snapshot source number."""
    k = F.col("source")
    rows = r.snapshots.groupBy("student", "strm").agg(
        F.max(flag(k % 11 == 0)).alias("grad_own"), F.max(flag(k % 13 == 0)).alias("grad_other"), F.max(flag(k % 3 == 0)).alias("enr_other"))
    return a.with_group_values(rows, "student", first=F.min("strm"))


def degrees(r):
    earned = r.snapshots.where(F.col("source") % 11 == 0)
    out = {}
    for kind, levels in KINDS.items():
        mine = F.col("deglvl").isin(list(levels))
        out |= {f"deg_{kind}": F.max(flag(mine)), f"deg_{kind}_strm": F.min(F.when(mine, F.col("strm")))}
    return a.collapse(earned, "student", **out)


OUTCOMES = """
rec AS (SELECT student, strm, max((source%11=0)::INT) AS grad_own, max((source%13=0)::INT) AS grad_other, max((source%3=0)::INT) AS enr_other, min(min(strm)) OVER (PARTITION BY student) AS first FROM snapshot_v GROUP BY student, strm),
inw AS (SELECT *, (3*floor((strm-first)/10) + CASE strm-first-10*floor((strm-first)/10) WHEN 8 THEN 1 WHEN 9 THEN 2 ELSE strm-first-10*floor((strm-first)/10) END + 1) BETWEEN 1 AND 18 AS ok FROM rec),
oc AS (SELECT student, first, max(grad_own) FILTER (WHERE ok) AS grad_own_6years, max(grad_other) FILTER (WHERE ok) AS grad_other_6years, max(enr_other) FILTER (WHERE ok) AS enr_other_6years,
  min(strm) FILTER (WHERE ok AND (grad_own=1 OR grad_other=1)) AS first_degree_strm, min(strm) FILTER (WHERE ok AND enr_other=1) AS first_other_strm, CASE WHEN first%10=2 THEN first+52 ELSE first+59 END AS last_strm FROM inw GROUP BY student, first),
dg AS (SELECT student, """ + ", ".join(
    f"max((coalesce(deglvl,'') IN ({', '.join(repr(x) for x in v)}))::INT) AS deg_{k}, min(CASE WHEN deglvl IN ({', '.join(repr(x) for x in v)}) THEN strm END) AS deg_{k}_strm" for k, v in KINDS.items()) + """ FROM snapshot_v WHERE source%11=0 GROUP BY student),
outc AS (SELECT oc.*, """ + ", ".join(
    f"CASE WHEN deg_{k}_strm > last_strm THEN 0 ELSE coalesce(deg_{k},0) END AS deg_{k}, CASE WHEN deg_{k}_strm <= last_strm THEN deg_{k}_strm END AS deg_{k}_strm" for k in KINDS) + """ FROM oc LEFT JOIN dg USING (student))"""


@query("l02_outcomes", f"WITH {OUTCOMES} SELECT * FROM outc")
def outcomes(r):
    return st.outcomes(records(r), degrees(r), KINDS)


@query("l03_elapsed_distribution", f"""
WITH {OUTCOMES}, gp AS (SELECT DISTINCT student, strm FROM snapshot_v WHERE total_credit_hrs > 0), en AS (SELECT DISTINCT student, strm FROM enrolment_v),
bad AS (SELECT DISTINCT gp.student FROM gp ANTI JOIN en USING (student, strm)), ok AS (SELECT en.* FROM en ANTI JOIN bad USING (student)),
e AS (SELECT ok.student, ok.strm, o.first FROM ok JOIN outc o USING (student) WHERE ok.strm IN (2002,2003,2004) AND NOT coalesce(o.first_degree_strm <= ok.strm, false) AND o.first <= ok.strm),
n AS (SELECT (3*floor((strm-first)/10) + CASE strm-first-10*floor((strm-first)/10) WHEN 8 THEN 1 WHEN 9 THEN 2 ELSE strm-first-10*floor((strm-first)/10) END + 1)::INT AS nth_term FROM e),
p AS (SELECT nth_term, count(*) AS n, count(*)/sum(count(*)) OVER ()::DOUBLE AS prop FROM n WHERE nth_term <= 17 GROUP BY nth_term),
q AS (SELECT *, round(prop*(SELECT count(DISTINCT student) FROM snapshot_v)) AS k FROM p)
SELECT nth_term, n, prop, (k + CASE WHEN nth_term=(SELECT min(nth_term) FROM q) THEN (SELECT count(DISTINCT student) FROM snapshot_v) - sum(k) OVER () ELSE 0 END)::BIGINT AS sample_size FROM q
""")
def elapsed_distribution(r):
    from cohortlens.operators.joins import exclude_inconsistent
    from cohortlens.operators.sampling import quota_sizes

    enrolled = r.enrolment.select("student", "strm").distinct()
    gpa = r.snapshots.where("total_credit_hrs > 0").select("student", "strm").distinct()
    consistent = exclude_inconsistent(enrolled, gpa, "student", ["student", "strm"])
    nth = st.elapsed_terms(consistent, st.outcomes(records(r), degrees(r), KINDS), [2002, 2003, 2004])
    props = a.share(a.freq(nth, "nth_term"), [], "n", "prop")
    return quota_sizes(props, "nth_term", "prop", r.snapshots.agg(F.count_distinct("student")).scalar())


RECORD = f"""
{FILLED}, gc AS (SELECT student, strm, sum(total_credit_hrs) AS g FROM snapshot_v GROUP BY ALL),
r1 AS (SELECT f.*, coalesce(gc.g,0) AS g, sum(credit) OVER (PARTITION BY f.student, f.strm) AS tot FROM filled f LEFT JOIN gc USING (student, strm)),
r2 AS (SELECT *, CASE WHEN tot < g THEN coalesce(credit*g/nullif(tot,0), credit) ELSE credit END AS sc, CASE WHEN grade IN ('A','B','C','D','F','I') THEN credit ELSE 0 END AS eff FROM r1),
ent AS (SELECT student, CASE WHEN sum(s) > 0 THEN -ln(max(s)/sum(s)) END AS college_entropy FROM (SELECT student, college, sum(sc) AS s FROM r2 GROUP BY ALL) GROUP BY student),
rt AS (SELECT student, strm, greatest(max(tot), max(g)) AS term_cred_att, sum(CASE WHEN grade='W' THEN sc ELSE 0 END) AS term_withdrawn, sum(CASE WHEN {EARN} THEN sc ELSE 0 END) AS term_cred_earn,
  sum(CASE WHEN {ATTEMPT} THEN sc ELSE 0 END) AS term_cred_att_2, sum(CASE WHEN {ATTEMPT} AND regexp_full_match(course_num,'2[0-9]{{2}}') THEN sc ELSE 0 END) AS term_lvl2_att,
  sum(CASE WHEN {ATTEMPT} AND NOT regexp_full_match(course_num,'[12][0-9]{{2}}') THEN sc ELSE 0 END) AS term_dev_att, sum(eff*{PTS})/nullif(sum(eff),0) AS term_gpa FROM r2 GROUP BY student, strm HAVING greatest(max(tot), max(g)) > 0),
trec AS (SELECT rt.*, college_entropy FROM rt LEFT JOIN ent USING (student))"""


def term_record_of(r):
    gpa = deal(r.snapshots, "student").groupBy("student", "strm").agg(F.sum("total_credit_hrs").alias("term_cred_gpa"))
    return st.term_record(r.enrolment, gpa, work_folder(r.spark))


@query("l04_term_record", f"WITH {RECORD} SELECT * FROM trec")
def term_record(r):
    return term_record_of(r)


PELL = f"""
{AID_TERMS}, s AS (SELECT student, year, term, budget, sum(CASE WHEN pell=0 AND budget IS NULL THEN NULL ELSE pell END) AS pell, sum(grants) AS grants FROM t GROUP BY ALL),
f AS (SELECT *, CASE WHEN budget IS NULL AND coalesce(pell,0)=0 THEN NULL ELSE (coalesce(pell,0)>0)::INT END AS flag FROM s),
ta AS (SELECT student, (10*(year-1800)+term)::INT AS strm, max(flag) AS pell, sum(grants) AS grants FROM f GROUP BY ALL)"""


def _entry(r):
    return r.snapshots.groupBy("student").agg(F.min("strm").alias("first"))


@query("l05_aid_record", f"""
WITH {PELL}, en AS (SELECT student, min(strm) AS first FROM snapshot_v GROUP BY student),
i AS (SELECT ta.*, floor((ta.strm-first)/10)+1 AS yr FROM ta JOIN en USING (student) WHERE ta.strm >= first AND ta.strm <= first+60-CASE WHEN first%10=4 THEN 2 ELSE 9 END),
y AS (SELECT student, {', '.join(f'coalesce(sum(CASE WHEN yr={k} THEN grants END),0) AS grants_yr{k}' for k in range(1, 7))} FROM i GROUP BY student)
SELECT i.student, i.strm, i.pell, {', '.join(f'grants_yr{k}' for k in range(1, 7))} FROM i JOIN y USING (student)
""")
def aid_record(r):
    return aidjobs.aid_record(r.aid, _entry(r), last_window_term(F.col("first")))


@query("l06_pell_status", f"""
WITH {PELL}, g AS (SELECT c.student, tm.strm, ta.pell, max(ta.pell) OVER (PARTITION BY c.student ORDER BY tm.strm) AS ever FROM student_v c CROSS JOIN (SELECT DISTINCT strm FROM snapshot_v) tm LEFT JOIN ta ON ta.student=c.student AND ta.strm=tm.strm)
SELECT student, strm, coalesce((ever=0)::INT,0) AS pell_ever_0, coalesce((ever=1)::INT,0) AS pell_ever_1, coalesce((pell=0)::INT,0) AS pell_target_0, coalesce((pell=1)::INT,0) AS pell_target_1 FROM g
""")
def pell_status(r):
    return aidjobs.pell_status(r.students.select("student"), calendar(r.snapshots, "strm"), aidjobs.term_aid(r.aid))


@query("l07_program_record", """
WITH sn AS (SELECT *, CASE WHEN source%9=0 THEN '0' || deglvl ELSE deglvl END AS curr, (floor(strm/10)+1800-source%3)::INT AS hs_year FROM snapshot_v),
tp AS (SELECT * FROM (SELECT *, max(dual_enrollment) OVER (PARTITION BY student, strm) AS dual, row_number() OVER (PARTITION BY student, strm ORDER BY total_credit_hrs DESC,
  CASE WHEN deglvl LIKE '%A%' THEN 4 WHEN deglvl='CERT' THEN 3 WHEN deglvl='CSC' THEN 2 ELSE 0 END DESC, md5(concat_ws('#', source, '1234'))) AS rn FROM sn) WHERE rn=1),
en AS (SELECT student, strm, min(strm) OVER (PARTITION BY student) AS first, (credit>0)::INT AS enrolled FROM (SELECT student, strm, sum(CASE WHEN section<4 THEN credit ELSE 0 END) AS credit FROM enrolment_v GROUP BY ALL)),
a AS (SELECT coalesce(en.student, tp.student) AS student, coalesce(en.strm, tp.strm) AS strm, en.first, en.enrolled, CASE WHEN en.enrolled=0 THEN NULL ELSE tp.curr END AS curr, (NOT coalesce(starts_with(tp.curr,'0'),false))::INT AS sk, tp.student IS NOT NULL AS has, tp.hs_year, tp.dual
  FROM en FULL JOIN tp ON en.student=tp.student AND en.strm=tp.strm),
hc AS (SELECT student, hs_year, count(*) AS n FROM a WHERE hs_year IS NOT NULL GROUP BY ALL), hm AS (SELECT student, max(hs_year) AS hs FROM hc WHERE n=(SELECT max(n) FROM hc h2 WHERE h2.student=hc.student) GROUP BY student),
fl AS (SELECT student, max(dual) AS dual_ind, (count(DISTINCT curr)>1)::INT AS program_chng_ind FROM a GROUP BY student)
SELECT a.student, a.strm, CASE WHEN enrolled=1 THEN CASE WHEN has THEN sk ELSE 1 END ELSE 0 END AS degree_seeking, dual_ind, coalesce((hs < floor(first/10)+1800)::INT,0) AS seamless_enrollee_0, coalesce((hs = floor(first/10)+1800)::INT,0) AS seamless_enrollee_1, program_chng_ind
FROM a JOIN fl USING (student) LEFT JOIN hm USING (student) WHERE enrolled IS NOT NULL
""")
def program_record(r):
    k = F.col("source")
    snaps = r.snapshots.select("student", "strm", "source", "total_credit_hrs", "dual_enrollment", F.col("deglvl").alias("curr_degree"),
                               F.when(k % 9 == 0, F.concat(F.lit("0"), "deglvl")).otherwise(F.col("deglvl")).alias("curr"),
                               (F.floor(F.col("strm") / 10) + 1800 - k % 3).cast("int").alias("hs_year"))
    per = r.enrolment.groupBy("student", "strm").agg(a.total_if(F.col("credit"), F.col("section") < 4).alias("c"))
    enrolled = a.with_group_values(per.select("student", "strm", flag(F.col("c") > 0).alias("enrolled")), "student", first=F.min("strm"))
    return st.program_record(snaps, enrolled)


@query("l08_pre_entry", f"""
WITH en AS (SELECT student, min(strm)+20 AS first FROM enrolment_v GROUP BY student),
gf AS (SELECT student, strm, college, sum(t) OVER w AS taken, sum(p) OVER w AS passed FROM (SELECT student, strm, college, sum(credit) AS t, sum(CASE WHEN grade IN ('A','B','C','D') THEN credit ELSE 0 END) AS p FROM enrolment_v GROUP BY ALL)
  WINDOW w AS (PARTITION BY student, college ORDER BY strm)),
l AS (SELECT gf.student, college, arg_max(taken, strm) AS taken, arg_max(passed, strm) AS passed FROM gf JOIN en USING (student) WHERE strm < first GROUP BY ALL),
fg AS (SELECT student, sum(taken) AS taken, sum(passed) AS passed, 1 AS in_gpa FROM l WHERE taken<>0 GROUP BY student),
cl AS (SELECT e.*, CASE WHEN regexp_full_match(course_num,'[0-9]{{3}}L') THEN substr(course_num,1,3) ELSE course_num END AS num FROM enrolment_v e JOIN en USING (student) WHERE strm < first),
ac AS (SELECT student, sum(CASE WHEN coalesce(grade,'') NOT IN ('W','X') THEN credit ELSE 0 END) AS prev_att, sum(CASE WHEN {EARN} THEN credit ELSE 0 END) AS prev_earn,
  sum(CASE WHEN grade IN ('A','B','C','D') AND NOT regexp_full_match(num,'[12][0-9]{{2}}') THEN credit ELSE 0 END) AS prev_dev, 1 AS in_class FROM cl WHERE credit<>0 GROUP BY student),
hr AS (SELECT student, sum(total_credit_hrs) AS hours FROM snapshot_v JOIN en USING (student) WHERE strm<first AND total_credit_hrs<>0 GROUP BY student),
kg AS (SELECT student, strm, max(CASE WHEN student%2=0 THEN distance/25 END) AS cum_gpa FROM snapshot_v GROUP BY ALL),
rc AS (SELECT student, (SELECT k2.cum_gpa FROM kg k2 WHERE k2.student=kg.student AND k2.strm=max(kg.strm)) AS gpa_recorded FROM kg JOIN en USING (student) WHERE strm<first GROUP BY student),
cm AS (SELECT student, sum(CASE WHEN grade IN ('A','B','C','D','F','I') THEN credit*{PTS} END)/nullif(sum(CASE WHEN grade IN ('A','B','C','D','F','I') THEN credit END),0) AS gpa_computed FROM cl GROUP BY student)
SELECT student, 1 AS enrolled_pre, coalesce(CASE WHEN in_gpa IS NULL AND in_class IS NOT NULL THEN hours-coalesce(prev_dev,0) ELSE hours END, coalesce(passed,prev_earn)-coalesce(prev_dev,0))/30.0::DOUBLE AS coll_lvl_cred_earn,
 coalesce(passed,prev_earn)/nullif(coalesce(taken,prev_att),0) AS prop_comp_pre, coalesce(gpa_recorded, gpa_computed) AS cum_gpa_pre
FROM en LEFT JOIN fg USING (student) LEFT JOIN ac USING (student) LEFT JOIN hr USING (student) LEFT JOIN rc USING (student) LEFT JOIN cm USING (student) WHERE in_gpa IS NOT NULL OR in_class IS NOT NULL OR hours IS NOT NULL
""")
def pre_entry(r):
    from cohortlens.operators.windows import running_sum

    entry = r.enrolment.groupBy("student").agg((F.min("strm") + 20).alias("first"))
    per = r.enrolment.groupBy("student", "strm", "college").agg(
        F.sum("credit").alias("t"), a.total_if(F.col("credit"), F.col("grade").isin("A", "B", "C", "D")).alias("p"))
    keys = ["student", "college"]
    gpa = per.select("student", "strm", "college", running_sum("t", keys).alias("taken"), running_sum("p", keys).alias("passed"))
    known = r.snapshots.groupBy("student", "strm").agg(F.max(F.when(F.col("student") % 2 == 0, F.col("distance") / 25)).alias("cum_gpa"))
    return st.pre_entry(entry, gpa, r.enrolment, r.snapshots, known)


EXTERNAL = f"""
{SPELL_TERMS}, sm AS (SELECT student, min(strm)+20 AS first, min(strm) AS earliest, min(strm)+41 AS last, student%2 AS valid FROM snapshot_v GROUP BY student),
xt AS (SELECT st.student, st.college, st.strm, CASE WHEN round(max(coalesce(intensity,0.01)),2) <> 0.01 THEN max(coalesce(intensity,0.01)) END AS intensity, (st.strm < sm.first)::INT AS pre FROM st JOIN sm USING (student) WHERE st.strm BETWEEN earliest AND last GROUP BY st.student, st.college, st.strm, sm.first)"""


def _external_sample(r):
    s = r.snapshots.groupBy("student").agg(F.min("strm").alias("earliest"))
    e = F.col("earliest")
    return s.select("student", (e + 20).alias("first"), e, (e + 41).alias("last"), (F.col("student") % 2).alias("valid"))


@query("l09_external_terms", f"WITH {EXTERNAL} SELECT * FROM xt")
def external_terms(r):
    return ext.external_terms(r.spells, _external_sample(r).drop("valid"), CALENDAR)


@query("l09_external_counts", f"""
WITH {EXTERNAL} SELECT student, count(DISTINCT college) FILTER (WHERE pre=1) AS pre_num_coll, count(DISTINCT college) FILTER (WHERE pre=0) AS num_coll,
 count(DISTINCT strm) FILTER (WHERE pre=1) AS pre_terms, count(DISTINCT strm) FILTER (WHERE pre=0) AS terms FROM xt GROUP BY student
""")
def external_counts(r):
    return ext.external_counts(ext.external_terms(r.spells, _external_sample(r).drop("valid"), CALENDAR))


QUALITY_SQL = """
nq AS (SELECT n_name AS college, CASE WHEN n_nationkey%5=0 THEN NULL ELSE n_nationkey*2.0::DOUBLE END AS admrate, CASE WHEN n_nationkey%3=0 THEN CASE WHEN n_nationkey%2=0 THEN NULL ELSE n_regionkey*1.0::DOUBLE END ELSE n_nationkey*1.0::DOUBLE END AS gradrate,
 """ + ", ".join(f"(4*(n_nationkey%2)+2*(n_regionkey%2)+(n_nationkey%3=0)::INT+1={i})::INT AS coll_type_{i}" for i in range(1, 9)) + " FROM nation)"


def _quality(r):
    n, k = r.table("nation"), F.col("n_nationkey")
    text = lambda cond, value: F.when(cond, "NULL").otherwise(value.cast("string"))
    raw = n.select(F.col("n_name").alias("college"), text(k % 5 == 0, k * 2).alias("adm_rate"), text(F.lit(True), k).alias("adm_rate_all"),
                   text(k % 3 == 0, k).alias("c150_4"), text(k % 2 == 0, F.col("n_regionkey")).alias("c150_l4"))
    quality = ext.school_quality(raw, {"admrate": ("adm_rate", "adm_rate_all"), "gradrate": ("c150_4", "c150_l4")})
    from cohortlens.operators.rows import college_type, one_hot

    kind = n.select(F.col("n_name").alias("college"), college_type(k % 2, F.col("n_regionkey") % 2, flag(k % 3 == 0)).alias("coll_type"))
    return quality, one_hot(kind, "coll_type", range(1, 9)).drop("coll_type")


@query("l10_external_quality", f"""
WITH {EXTERNAL}, {QUALITY_SQL}, po AS (SELECT xt.*, sm.valid, strm%10=3 AS su FROM xt JOIN sm USING (student) WHERE pre=0),
me AS (SELECT avg(intensity) FILTER (WHERE valid=0 AND NOT su) AS m1, avg(intensity) FILTER (WHERE valid=0 AND su) AS m2 FROM po),
pc AS (SELECT student, college, sum(coalesce(intensity, CASE WHEN su THEN m2 ELSE m1 END)) AS w FROM po, me GROUP BY ALL)
SELECT student, {', '.join(f'sum({q}*w)/nullif(sum(CASE WHEN {q} IS NOT NULL THEN w END),0) AS {q}' for q in ('admrate', 'gradrate'))}, {', '.join(f'max(coll_type_{i}) AS coll_type_{i}' for i in range(1, 9))} FROM pc LEFT JOIN nq USING (college) GROUP BY student
""")
def external_quality(r):
    sample = _external_sample(r)
    terms = ext.external_terms(r.spells, sample.drop("valid"), CALENDAR)
    quality, types = _quality(r)
    return ext.external_quality(terms, sample, quality, types, ["admrate", "gradrate"], [f"coll_type_{i}" for i in range(1, 9)])


@query("l11_cumulative_gpa", f"""
WITH lt AS (SELECT student, max(strm)-10 AS last_term, max(CASE WHEN student%2=0 THEN distance/25 END) AS cum_gpa FROM snapshot_v GROUP BY student),
c AS (SELECT student, sum(CASE WHEN grade IN ('A','B','C','D','F','I') THEN credit*{PTS} END)/nullif(sum(CASE WHEN grade IN ('A','B','C','D','F','I') THEN credit END),0) AS g FROM enrolment_v JOIN lt USING (student) WHERE strm <= last_term GROUP BY student)
SELECT student, coalesce(cum_gpa, g) AS cum_gpa FROM lt LEFT JOIN c USING (student)
""")
def cumulative_gpa(r):
    last = r.snapshots.groupBy("student").agg((F.max("strm") - 10).alias("last_term"), F.max(F.when(F.col("student") % 2 == 0, F.col("distance") / 25)).alias("cum_gpa"))
    return st.cumulative_gpa(last, r.enrolment)


REPEATS = """
tk AS (SELECT DISTINCT student, strm, subject || CASE WHEN regexp_full_match(course_num,'[0-9]{3}L') THEN substr(course_num,1,3) ELSE course_num END AS course FROM enrolment_v WHERE coalesce(grade,'') NOT IN ('X','XN','W')),
rep AS (SELECT student, strm, sum((EXISTS (SELECT 1 FROM tk b WHERE b.student=a.student AND b.course=a.course AND b.strm<a.strm))::INT)::BIGINT AS repeated FROM tk a WHERE course NOT LIKE '%5' GROUP BY student, strm)"""


def repeats_of(r):
    from cohortlens.functions.grades import clean_course_number

    repeatable = r.enrolment.select(F.concat("subject", clean_course_number(F.col("course_num"))).alias("course")).where(F.col("course").endswith("5")).distinct()
    return st.repeated_courses(r.enrolment, repeatable)


@query("l12_repeated_courses", f"WITH {REPEATS} SELECT * FROM rep")
def repeated_courses(r):
    return repeats_of(r)


SLOT_COLS = {"enrolled": "1", "term_cred_att": "term_cred_att", "term_gpa": "term_gpa", "prop_comp_term": "term_cred_earn/nullif(term_cred_att_2,0)", "repeat": "coalesce(repeated,0)"}


@query("l13_student_features", f"""
WITH {RECORD}, {REPEATS}, fs AS (SELECT student, min(strm) AS first FROM trec GROUP BY student),
sl AS (SELECT t.*, repeated, CASE t.strm%10 WHEN 2 THEN 'sp' WHEN 3 THEN 'su' ELSE 'fa' END || CAST(floor((t.strm-first)/10)+1 AS INT) AS slot FROM trec t JOIN fs USING (student) LEFT JOIN rep ON rep.student=t.student AND rep.strm=t.strm),
wd AS (SELECT student, {', '.join(f"coalesce(max(CASE WHEN slot='{s}' THEN {e} END),0) AS {c}_{s}" for c, e in SLOT_COLS.items() for s in SLOTS)} FROM sl GROUP BY student),
tt AS (SELECT student, sum(term_cred_earn)/nullif(sum(term_cred_att_2),0) AS prop_comp, sum(term_withdrawn)/nullif(sum(term_cred_att),0) AS withdrawn_prop_comp, sum(term_lvl2_att)/nullif(sum(term_cred_att_2),0) AS lvl2_prop_comp,
  sum(term_dev_att)/nullif(sum(term_cred_att_2),0) AS dev_prop_comp, stddev_samp(term_cred_earn/nullif(term_cred_att_2,0)) AS prop_comp_sd, stddev_samp(term_withdrawn/nullif(term_cred_att,0)) AS withdrawn_prop_comp_sd, max(college_entropy) AS college_entropy FROM trec GROUP BY student),
ev AS (SELECT student, (max(repeated)>0)::INT AS ri FROM rep GROUP BY student), ay AS (SELECT student, ln(sum(grants)+1) AS grants_all FROM aid_v GROUP BY student)
SELECT tt.*, wd.* EXCLUDE (student), grants_all, coalesce(ri,0) AS repeat_ind, ({'+'.join(f'enrolled_{s}' for s in SLOTS)})/17.0::DOUBLE AS pct_enrolled FROM tt JOIN wd USING (student) LEFT JOIN ev USING (student) LEFT JOIN ay USING (student)
""")
def student_features(r):
    aid = r.aid.groupBy("student").agg(F.sum("grants").alias("grants_all"))
    return st.student_features(st.student_tables(term_record_of(r), repeats_of(r), aid, work_folder(r.spark)))


@query("l14_first_generation", """
WITH l AS (SELECT student, max(coalesce(fhe,0)) AS f, max(coalesce(mhe,0)) AS m FROM snapshot_v s WHERE source=(SELECT max(source) FROM snapshot_v z WHERE z.student=s.student) GROUP BY student), p AS (SELECT student, CASE WHEN least(f,m)=0 THEN 0 ELSE greatest(f,m) END AS phe FROM l)
SELECT student, (phe>3)::INT AS firstgen_0, (phe BETWEEN 1 AND 3)::INT AS firstgen_1 FROM p
""")
def first_generation(r):
    return st.first_generation(r.snapshots)


PICKED = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student, strm ORDER BY total_credit_hrs DESC, source) AS rn FROM snapshot_v) WHERE rn=1"


@query("l15_neighbourhood", f"""
WITH ag AS (SELECT zcta, (floor(strm/10)+1800)::INT AS year, sum(total_credit_hrs) AS i, sum(fhe) AS p FROM snapshot_v WHERE zcta IS NOT NULL AND zcta NOT LIKE '%9' GROUP BY ALL),
ar AS (SELECT zcta, year, CASE WHEN zcta NOT LIKE '%3' THEN i END AS income, CASE WHEN zcta NOT LIKE '%7' THEN p END AS poverty FROM ag),
p AS ({PICKED}), zc AS (SELECT student, zcta, count(*) AS n FROM p WHERE zcta IS NOT NULL GROUP BY ALL), us AS (SELECT student, CASE WHEN count(*)=1 THEN min(zcta) END AS usual FROM zc WHERE n=(SELECT max(n) FROM zc z2 WHERE z2.student=zc.student) GROUP BY student),
a AS (SELECT p.student, p.strm, (p.zcta IS NULL)::INT AS kind, coalesce(p.zcta, us.usual) AS zcta FROM p LEFT JOIN us USING (student)),
b AS (SELECT *, coalesce(zcta, lag(zcta) OVER (PARTITION BY student ORDER BY strm)) AS z1 FROM a),
c AS (SELECT *, coalesce(z1, first_value(z1 IGNORE NULLS) OVER (PARTITION BY student ORDER BY strm ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS z2 FROM b),
d AS (SELECT student, strm, coalesce(z2,'00000') AS zcta, CASE WHEN z2 IS NULL THEN 2 ELSE kind END AS kind, (floor(strm/10)+1800)::INT AS year FROM c),
e AS (SELECT d.*, income, poverty FROM d LEFT JOIN ar USING (zcta, year))
SELECT student, strm, zcta, {', '.join(f"CASE WHEN kind=2 THEN 6 WHEN kind=1 THEN kind*2+({x} IS NULL)::INT+1 ELSE kind*2+({x} IS NULL)::INT END AS {x}_mi_type, coalesce({x}::DOUBLE, avg({x}) OVER ()) AS {x}" for x in ("income", "poverty"))} FROM e
""")
def neighbourhood(r):
    z = F.col("zcta")
    known = r.snapshots.where(z.isNotNull() & ~z.endswith("9"))
    area = known.groupBy("zcta", (F.floor(F.col("strm") / 10) + 1800).cast("int").alias("year")).agg(
        F.sum("total_credit_hrs").alias("i"), F.sum("fhe").alias("p")).select(
        "zcta", "year", F.when(~z.endswith("3"), F.col("i")).alias("income"), F.when(~z.endswith("7"), F.col("p")).alias("poverty"))
    return st.neighbourhood(r.snapshots, area)


@query("l15_home_distance", f"""
WITH p AS ({PICKED}), a AS (SELECT student, strm, (distance IS NULL)::INT AS kind, last_value(distance IGNORE NULLS) OVER (PARTITION BY student ORDER BY strm) AS d FROM p),
b AS (SELECT student, strm, kind, first_value(d IGNORE NULLS) OVER (PARTITION BY student ORDER BY strm ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS d FROM a)
SELECT student, strm, CASE WHEN d IS NULL THEN 2 ELSE kind END AS distance_mi_type, coalesce(d, avg(d) OVER ()) AS distance FROM b
""")
def home_distance(r):
    return st.home_distance(r.snapshots)


@query("l16_degree_level", """
WITH s AS (SELECT student, strm, source, total_credit_hrs, CASE WHEN deglvl IN ('AA&S','AAS','CERT','CSC') THEN deglvl ELSE 'OTHER' END AS level FROM snapshot_v),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student, strm ORDER BY level, total_credit_hrs DESC, source) AS rn FROM s) WHERE rn=1),
l AS (SELECT student, max(strm) AS last_term FROM enrolment_v GROUP BY student)
SELECT l.student, coalesce(o.level,'OTHER') AS deglvl FROM l LEFT JOIN o ON o.student=l.student AND o.strm=l.last_term
""")
def degree_level(r):
    return st.degree_level_at(r.snapshots, r.enrolment.groupBy("student").agg(F.max("strm").alias("last_term")))


@query("l16_program_at_term", """
WITH s AS (SELECT student, strm, source, total_credit_hrs, (source%40)::BIGINT AS cip, CASE deglvl WHEN 'AA&S' THEN 1 WHEN 'AAS' THEN 2 WHEN 'CERT' THEN 3 WHEN 'CSC' THEN 4 ELSE 5 END AS lvl FROM snapshot_v),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student, strm ORDER BY lvl, total_credit_hrs DESC, source) AS rn FROM s) WHERE rn=1)
SELECT student, strm, CASE WHEN count(*) OVER (PARTITION BY cip) < 0.01*count(*) OVER () THEN 99 ELSE cip END AS cip, lvl FROM o
""")
def program_at_term(r):
    from cohortlens.functions.codes import intended_rank
    from cohortlens.operators.rows import collapse_rare

    k = F.col("source")
    s = r.snapshots.select("student", "strm", "source", "total_credit_hrs", (k % 40).alias("cip"), intended_rank(F.col("deglvl")).alias("lvl"))
    one = st.program_at(s, ["student", "strm"], [F.col("lvl"), -F.col("total_credit_hrs"), F.col("source")])
    return collapse_rare(one.select("student", "strm", "cip", "lvl"), "cip", 0.01, 99)


SCORED = """sc AS (SELECT v.home, v.grp, q.y, s.deglvl, s.source%40 AS cip FROM scores_v q JOIN snapshot_v s ON s.source=q.id JOIN student_v v ON v.student=s.student)"""


def _scored(r):
    return r.scores.join(r.snapshots, F.col("id") == F.col("source")).join(r.students.select("student", "home"), "student").select(
        "home", "grp", "y", "deglvl", (F.col("source") % 40).alias("cip"))


CROSSES = [["home"], ["cip"], ["deglvl"], ["home", "cip"], ["cip", "deglvl"], ["home", "deglvl"], ["home", "cip", "deglvl"]]


@query("l33_rates_by_crosses", f"WITH {SCORED} SELECT GROUPING(home, cip, deglvl)::BIGINT AS summed, home, cip, deglvl, avg(y) AS rate, " + ", ".join(
    f"avg(CASE WHEN grp='{g}' THEN y END) AS rate_{g}, sum((grp='{g}')::INT)/count(*)::DOUBLE AS share_{g}" for g in GROUPS)
    + ", count(*) AS n FROM sc GROUP BY GROUPING SETS (" + ", ".join(f"({', '.join(c)})" for c in CROSSES) + ")")
def rates_by_crosses(r):
    """Rates and shares by college, program, level and each of their crosses; the bits of ``summed`` tell which of the three
    a row adds up over."""
    mine = lambda g: F.col("grp") == g
    sets = [[F.col(c) for c in cross] for cross in CROSSES]
    return _scored(r).groupingSets(sets, "home", "cip", "deglvl").agg(
        F.grouping_id().alias("summed"), F.avg("y").alias("rate"), *[m.mean_if(F.col("y"), mine(g)).alias(f"rate_{g}") for g in GROUPS],
        *[(F.count_if(mine(g)) / F.count(F.lit(1))).alias(f"share_{g}") for g in GROUPS], F.count(F.lit(1)).alias("n"))


@query("l33_rates_by_program", f"WITH {SCORED}, t AS (SELECT deglvl FROM sc WHERE deglvl IS NOT NULL GROUP BY deglvl ORDER BY count(*) DESC, deglvl LIMIT 3) SELECT home, deglvl, " + ", ".join(
    f"avg(CASE WHEN grp='{g}' THEN y END) AS rate_{g}, sum((grp='{g}')::INT)/count(*)::DOUBLE AS share_{g}" for g in GROUPS) + ", count(*) AS n FROM sc SEMI JOIN t USING (deglvl) GROUP BY home, deglvl HAVING count(*) >= 50")
def rates_by_program(r):
    from cohortlens.operators.toplists import top_categories

    rows = _scored(r)
    top = top_categories(rows, "deglvl", 3, None)
    mine = lambda g: F.col("grp") == g
    return rows.join(top.select("deglvl"), "deglvl", "left_semi").groupBy("home", "deglvl").agg(
        *[m.mean_if(F.col("y"), mine(g)).alias(f"rate_{g}") for g in GROUPS],
        *[(F.count_if(mine(g)) / F.count(F.lit(1))).alias(f"share_{g}") for g in GROUPS], F.count(F.lit(1)).alias("n")).where("n >= 50")


@query("l33_share_on_rate", f"WITH {SCORED}, tb AS (SELECT home, avg(CASE WHEN grp='white' THEN y END) AS rate, sum((grp='afam')::INT)/count(*)::DOUBLE AS share FROM sc GROUP BY home) SELECT *, {t_sql('t', '(n-2)')} AS p_value FROM (" + OLS_SQL.format(
    k="", y="share", x="rate", src="tb", g="") + ")")
def share_on_rate(r):
    rows = _scored(r)
    rate = a.rate_table(rows, "home", "grp", GROUPS, "y").select("home", F.col("white").alias("rate"))
    share = a.share_table(rows, "home", "grp", GROUPS).select("home", F.col("afam").alias("share"))
    return m.ols1(rate.join(share, "home"), "rate", "share")
