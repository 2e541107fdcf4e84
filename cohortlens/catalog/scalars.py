"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from cohortlens.catalog.registry import query
from cohortlens.catalog.sql_parts import p_sql
from cohortlens.functions import codes, grades as g, terms as t
from cohortlens.functions.nulls import flag
from cohortlens.functions.stats import normal_cdf

KEY = "student, strm, college, subject, course_num, section"
KEYS = KEY.split(", ")


@query("i01_clean_course_number", f"""
SELECT {KEY}, CASE WHEN regexp_full_match(c, '[0-9]{{3}}L') THEN substr(c,1,3) ELSE c END AS num, CASE WHEN regexp_full_match(d, '[0-9]{{3}}L') THEN substr(d,1,3) ELSE d END AS num4
FROM (SELECT *, CASE WHEN regexp_full_match(course_num, '[0-9]{{4}}L') THEN substr(course_num,2) ELSE course_num END AS c,
  CASE WHEN regexp_full_match('1' || course_num, '[0-9]{{4}}L') THEN course_num ELSE '1' || course_num END AS d FROM enrolment_v)
""")
def clean_course_number(r):
    return r.enrolment.select(*KEYS, g.clean_course_number(F.col("course_num")).alias("num"),
                              g.clean_course_number(F.concat(F.lit("1"), "course_num")).alias("num4"))


@query("i02_level_tests", f"""
SELECT {KEY}, regexp_full_match(course_num,'[1-9][0-9]{{2}}')::INT AS college_level, regexp_full_match(course_num,'2[0-9]{{2}}')::INT AS second_year,
 (NOT regexp_full_match(course_num,'[12][0-9]{{2}}'))::INT AS developmental, (course_num IN ('I','II','III','IV') OR length(course_num) < 3)::INT AS short FROM enrolment_v
""")
def level_tests(r):
    c = F.col("course_num")
    return r.enrolment.select(*KEYS, g.is_college_level(c).cast("int").alias("college_level"), g.is_second_year(c).cast("int").alias("second_year"),
                              g.is_developmental(c).cast("int").alias("developmental"), g.is_short_number(c).cast("int").alias("short"))


@query("i03_grade_points", f"""
SELECT {KEY}, CASE grade WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 ELSE 0 END AS points,
 CASE WHEN grade IN ('A','B','C','D','F','I') THEN credit ELSE 0 END AS effective, CASE WHEN grade='W' THEN credit/3 WHEN grade IN ('X','XY','XN','R') THEN credit/2 ELSE credit END AS adjusted,
 CASE WHEN grade IN ('X','XN') THEN credit/2 ELSE credit END AS audit_halved FROM enrolment_v
""")
def grade_points(r):
    c, gr = F.col("credit"), F.col("grade")
    return r.enrolment.select(*KEYS, g.points(gr).alias("points"), g.effective_credit(c, gr).alias("effective"),
                              g.adjusted_credit(c, gr).alias("adjusted"), g.audit_halved(c, gr).alias("audit_halved"))


@query("i04_grade_classes", f"""
SELECT {KEY}, (coalesce(grade,'') IN ('A','B','C','D','S','P','N','*',''))::INT AS earned, (coalesce(grade,'') NOT IN ('W','X','XN'))::INT AS attempted,
 (coalesce(grade,'') IN ('','*','K','N','Z','XN','R','I','X','XY'))::INT AS unknown, (coalesce(grade,'') IN ('A','B','C','D','F','W'))::INT AS eligible FROM enrolment_v
""")
def grade_classes(r):
    from cohortlens.functions.nulls import in_list

    gr = F.col("grade")
    return r.enrolment.select(*KEYS, in_list(gr, g.EARNED).cast("int").alias("earned"), (~in_list(gr, g.NOT_ATTEMPTED)).cast("int").alias("attempted"),
                              in_list(gr, g.UNKNOWN).cast("int").alias("unknown"), in_list(gr, g.OUTCOME).cast("int").alias("eligible"))


@query("i05_term_codes", """
SELECT DISTINCT strm, strm%10 AS season, (floor(strm/10)+1800)::INT AS year, (floor(strm/10)+1800 - CASE WHEN strm%10=2 THEN 1 ELSE 0 END)::INT AS fiscal,
 (strm + 60 - CASE WHEN strm%10=4 THEN 2 ELSE 9 END)::INT AS last_window, CASE WHEN strm%10=2 THEN strm+52 ELSE strm+59 END::INT AS last_observed FROM snapshot_v
""")
def term_codes(r):
    s = F.col("strm")
    return r.snapshots.select(s, t.season(s).alias("season"), t.year_of(s).alias("year"), t.fiscal_year(s).alias("fiscal"),
                              t.last_window_term(s).alias("last_window"), t.last_observed_term(s).alias("last_observed")).distinct()


@query("i06_previous_term", "SELECT source, CASE WHEN strm%10=2 THEN strm-8 ELSE strm-1 END::INT AS prev FROM snapshot_v")
def previous_term(r):
    return r.snapshots.select("source", t.previous_term(F.col("strm")).alias("prev"))


@query("i07_date_parts", "SELECT student, college, year(begin_date) AS begin_year, month(begin_date) AS begin_month, year(end_date) AS end_year, month(end_date) AS end_month, count(*) AS n FROM spells_v GROUP BY ALL")
def date_parts(r):
    return r.spells.groupBy("student", "college", F.year("begin_date").alias("begin_year"), F.month("begin_date").alias("begin_month"),
                            F.year("end_date").alias("end_year"), F.month("end_date").alias("end_month")).agg(F.count(F.lit(1)).alias("n"))


@query("i08_log1p", "SELECT student, year, ln(pell+1) AS log_pell FROM aid_v")
def log1p(r):
    return r.aid.select("student", "year", F.log1p("pell").alias("log_pell"))


@query("i09_arithmetic", """
SELECT source, floor(distance)::BIGINT AS f, ceil(distance)::BIGINT AS c, trunc(distance)::BIGINT AS i, total_credit_hrs % 5 AS m, sqrt(distance) AS s, abs(distance-50) AS a, pow(distance,2) AS p,
 round_even(total_credit_hrs/8.0::DOUBLE, 1) AS half_even, round(total_credit_hrs/8.0::DOUBLE, 1) AS half_up FROM snapshot_v
""")
def arithmetic(r):
    d, h = F.col("distance"), F.col("total_credit_hrs")
    return r.snapshots.select("source", F.floor(d).alias("f"), F.ceil(d).alias("c"), d.cast("bigint").alias("i"), (h % 5).alias("m"), F.sqrt(d).alias("s"),
                              F.abs(d - 50).alias("a"), F.pow(d, F.lit(2)).alias("p"), F.bround(h / 8, 1).alias("half_even"), F.round(h / 8, 1).alias("half_up"))


@query("i10_strings", """
SELECT DISTINCT college, replace(college,' ','_') AS under, subject || '_' || course_num AS course, split_part(subject || '_' || course_num, '_', 2) AS num,
 substr(subject,1,2) AS prefix, right(course_num,1) AS suffix, regexp_replace(course_num,'^1','') AS stripped, starts_with(course_num,'2')::INT AS starts, ends_with(course_num,'L')::INT AS ends FROM enrolment_v
""")
def strings(r):
    course = F.concat_ws("_", "subject", "course_num")
    n = F.col("course_num")
    return r.enrolment.select("college", F.replace("college", F.lit(" "), F.lit("_")).alias("under"), course.alias("course"), F.split(course, "_")[1].alias("num"),
                              F.substring("subject", 1, 2).alias("prefix"), F.right(n, F.lit(1)).alias("suffix"), F.regexp_replace(n, "^1", "").alias("stripped"),
                              n.startswith("2").cast("int").alias("starts"), n.endswith("L").cast("int").alias("ends")).distinct()


SUBJECT_SQL = "CASE " + " ".join(f"WHEN subject IN ({', '.join(repr(s) for s in v)}) THEN '{k}'" for k, v in codes.SUBJECT_CLUSTERS.items()) + " ELSE 'OTH' END"


@query("i11_code_lists", """
SELECT source, CASE WHEN deglvl LIKE '%A%' THEN 4 WHEN deglvl='CERT' THEN 3 WHEN deglvl='CSC' THEN 2 ELSE 0 END AS degree_rank,
 CASE deglvl WHEN 'AA&S' THEN 1 WHEN 'AAS' THEN 2 WHEN 'CERT' THEN 3 WHEN 'CSC' THEN 4 ELSE 5 END AS intended FROM snapshot_v
""")
def code_lists(r):
    d = F.col("deglvl")
    return r.snapshots.select("source", codes.degree_rank(d).alias("degree_rank"), codes.intended_rank(d).alias("intended"))


_NAMES = list(codes.COLLEGE_CODES)


@query("i11_college_codes", f"""
WITH n AS (SELECT n_nationkey, [{', '.join(f"'{x}'" for x in [*_NAMES, 'Elsewhere'])}][n_nationkey % {len(_NAMES) + 1} + 1] AS college FROM nation),
m AS (SELECT unnest([{', '.join(f"'{x}'" for x in _NAMES)}]) AS college, unnest([{', '.join(f"'{x}'" for x in codes.COLLEGE_CODES.values())}]) AS code)
SELECT n.college, m.code, count(*) AS n FROM enrolment_v e JOIN n ON e.college = 'NATION_' || n.n_nationkey LEFT JOIN m ON m.college = n.college GROUP BY ALL
""")
def college_codes(r):
    names = F.array(*[F.lit(x) for x in [*_NAMES, "Elsewhere"]])
    key = F.substring_index("college", "_", -1).cast("int")
    named = r.enrolment.select(F.get(names, key % (len(_NAMES) + 1)).alias("college"))
    counts = named.groupBy("college").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("college", codes.college_code(F.col("college")).alias("code"), "n")


@query("i11_subject_cluster", f"SELECT subject, {SUBJECT_SQL} AS cluster, count(*) AS n FROM enrolment_v GROUP BY ALL")
def subject_cluster(r):
    return r.enrolment.groupBy("subject", codes.subject_cluster(F.col("subject")).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("i11_status_intensity", """
SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.75 WHEN '3-MEDIUM' THEN 0.5 WHEN '5-LOW' THEN 0.25 ELSE NULL END::DOUBLE AS intensity FROM orders
""")
def status_intensity(r):
    p = F.col("o_orderpriority")
    status = F.when(p == "1-URGENT", "Full-Time").when(p == "2-HIGH", "Three-Quarter Time").when(p == "3-MEDIUM", "Half-Time").when(p == "5-LOW", "Less than Half-Time")
    return r.orders.select(F.col("o_orderkey").alias("id"), codes.status_intensity(status).alias("intensity"))


@query("i12_missing_code", """
SELECT source, CASE WHEN zm=2 THEN 6 WHEN zm=1 THEN zm*2+vm+1 ELSE zm*2+vm END AS code FROM (SELECT source, CASE WHEN zcta IS NULL AND distance IS NULL THEN 2 WHEN zcta IS NULL THEN 1 ELSE 0 END AS zm, (fhe IS NULL)::INT AS vm FROM snapshot_v)
""")
def missing_code(r):
    z = F.when(F.col("zcta").isNull() & F.col("distance").isNull(), 2).when(F.col("zcta").isNull(), 1).otherwise(0)
    return r.snapshots.select("source", codes.missing_code(z, flag(F.col("fhe").isNull())).alias("code"))


@query("i13_normal_cdf", f"SELECT id, CASE WHEN z >= 0 THEN 1 - {p_sql('z')}/2 ELSE {p_sql('z')}/2 END AS p FROM (SELECT id, 6*score-3 AS z FROM scores_v)")
def cdf(r):
    return r.scores.select("id", normal_cdf(6 * F.col("score") - 3).alias("p"))


@query("i14_seeded_key", "SELECT id, md5(concat_ws('#', id, grp, '1234')) AS key FROM scores_v")
def seeded_key(r):
    return r.scores.select("id", codes.seeded_key(1234, F.col("id"), F.col("grp")).alias("key"))


@query("i15_placeholder_code", """
WITH c AS (SELECT DISTINCT college, CASE WHEN length(college) % 2 = 0 THEN 'C' || length(college) END AS code, n_regionkey AS state FROM spells_v JOIN nation ON n_name=college),
m AS (SELECT college, state, '999999-' || dense_rank() OVER (ORDER BY college, state) AS new FROM c WHERE code IS NULL)
SELECT c.college, c.state, coalesce(c.code, m.new) AS code FROM c LEFT JOIN m USING (college, state)
""")
def placeholder_code(r):
    from cohortlens.plans.external import placeholder_codes

    c = r.spells.join(r.table("nation"), F.col("n_name") == F.col("college")).select(
        "college", F.col("n_regionkey").alias("state"),
        F.when(F.length("college") % 2 == 0, F.concat(F.lit("C"), F.length("college").cast("string"))).alias("code")).distinct()
    return placeholder_codes(c, "code", ["college", "state"])
