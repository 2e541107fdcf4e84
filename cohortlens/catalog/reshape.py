"""Reshaping, sorting, top lists and set operations."""

from pyspark.sql import functions as F

from cohortlens.catalog.joins import MERGE, late_terms
from cohortlens.catalog.registry import query
from cohortlens.catalog.windows import PER_TERM, SNAP, per_term, snap
from cohortlens.functions.codes import CLUSTERS, subject_cluster
from cohortlens.functions.terms import SLOTS
from cohortlens.operators import aggs as a
from cohortlens.operators import reshape as s
from cohortlens.operators import toplists as top
from cohortlens.operators import setops
from cohortlens.plans import measures as m

YEARS = list(range(1995, 2002))


@query("f01_widen", "SELECT student, " + ", ".join(
    f"max(CASE WHEN year={y} THEN credfal END)::BIGINT AS credfal_{y}, max(CASE WHEN year={y} THEN credspr END)::BIGINT AS credspr_{y}" for y in YEARS) + " FROM aid_v GROUP BY student")
def widen(r):
    return s.widen(r.aid, "student", "year", ["credfal", "credspr"], YEARS)


@query("f02_lengthen", """
SELECT student, year, 2 AS term, credspr::BIGINT AS cred FROM aid_v UNION ALL SELECT student, year, 3, credsum::BIGINT FROM aid_v UNION ALL SELECT student, year, 4, credfal::BIGINT FROM aid_v
""")
def lengthen(r):
    return s.lengthen(r.aid, ["student", "year"], {"cred": {2: "credspr", 3: "credsum", 4: "credfal"}}, "term")


@query("f03_densify", f"""
WITH {SNAP} SELECT i.student, t.strm, snap.distance FROM (SELECT DISTINCT student FROM snap) i CROSS JOIN (SELECT DISTINCT strm FROM snap) t
LEFT JOIN snap ON snap.student=i.student AND snap.strm=t.strm
""")
def densify(r):
    return s.densify(snap(r).select("student", "strm", "distance"), "student", "strm")


FIRST = "f AS (SELECT student, min(strm) AS first FROM per GROUP BY student)"
SLOT = """CASE per.strm%10 WHEN 2 THEN 'sp' WHEN 3 THEN 'su' ELSE 'fa' END || CAST(floor((per.strm-first)/10)+1 AS INT)"""


def _with_first(per):
    return a.with_group_values(per, "student", first=F.min("strm"))


@query("f04_term_slots", f"""
WITH {PER_TERM}, {FIRST}, s AS (SELECT per.*, {SLOT} AS slot FROM per JOIN f USING (student))
SELECT student, """ + ", ".join(f"coalesce(max(CASE WHEN slot='{x}' THEN {c} END),0) AS {c}_{x}" for c in ("credit", "withdrawn") for x in SLOTS) + " FROM s GROUP BY student")
def term_slots(r):
    per = _with_first(per_term(r))
    return s.term_slots(per, "student", "first", "strm", ["credit", "withdrawn"])


@query("f05_year_buckets", f"""
WITH {PER_TERM}, {FIRST}, s AS (SELECT per.*, floor((per.strm-first)/10)+1 AS yr FROM per JOIN f USING (student))
SELECT student, """ + ", ".join(f"coalesce(sum(CASE WHEN yr={y} THEN credit END),0) AS credit_yr{y}" for y in range(1, 7)) + " FROM s GROUP BY student")
def year_buckets(r):
    return s.year_buckets(_with_first(per_term(r)), "student", "first", "strm", ["credit"])


@query("f06_first_term_slot", f"""
WITH {PER_TERM}, {FIRST}, s AS (SELECT per.*, {SLOT} AS slot FROM per JOIN f USING (student)),
g AS (SELECT student, """ + ", ".join(
    f"coalesce(max(CASE WHEN slot='{x}1' THEN credit END),0) AS credit_{x}1, coalesce(max(CASE WHEN slot='{x}1' THEN 1 END),0) AS enrolled_{x}1" for x in ("fa", "sp", "su")) + """ FROM s GROUP BY student)
SELECT student, CASE WHEN enrolled_su1=1 THEN credit_su1 WHEN enrolled_sp1=1 THEN credit_sp1 ELSE credit_fa1 END AS credit_tm1 FROM g""")
def first_term_slot(r):
    per = _with_first(per_term(r)).withColumn("enrolled", F.lit(1))
    wide = s.term_slots(per, "student", "first", "strm", ["credit", "enrolled"], ["fa1", "sp1", "su1"])
    return wide.withColumns(s.first_term_slot(["credit"])).select("student", "credit_tm1")


@query("f07_cluster_columns", "WITH c AS (SELECT student, CASE subject WHEN 'ECO' THEN 'SOC' ELSE 'OTH' END AS cluster, credit FROM enrolment_v) SELECT student, "
       + ", ".join(f"coalesce(sum(CASE WHEN cluster='{c}' THEN credit END),0) AS credit_{c}" for c in CLUSTERS) + " FROM c GROUP BY student")
def cluster_columns(r):
    e = r.enrolment.withColumn("cluster", subject_cluster(F.col("subject")))
    return s.widen(e, "student", "cluster", ["credit"], CLUSTERS, agg=F.sum, fill=0)


@query("g01_order_by", "SELECT student, strm, source FROM snapshot_v ORDER BY student, strm, source")
def order_by(r):
    return top.ordered(r.snapshots.select("student", "strm", "source"), ["student", "strm", "source"])


@query("g02_top_categories", "SELECT course, n FROM (SELECT subject || '_' || course_num AS course, count(*) AS n FROM enrolment_v GROUP BY 1) WHERE course <> 'ECO_1' ORDER BY n DESC, course LIMIT 15")
def top_categories(r):
    return top.top_categories(r.enrolment.select(F.concat_ws("_", "subject", "course_num").alias("course")), "course", 15, "ECO_1")


@query("g03_frequent", "SELECT course, n FROM (SELECT subject || '_' || course_num AS course, count(*) AS n FROM enrolment_v GROUP BY 1) WHERE course <> 'ECO_1' AND n >= 60")
def frequent(r):
    return top.frequent(r.enrolment.select(F.concat_ws("_", "subject", "course_num").alias("course")), "course", 60, "ECO_1")


@query("g05_percentiles",
       "SELECT grp, unnest([0.1::DOUBLE,0.25,0.5,0.75,0.9]) AS prob, unnest(quantile_cont(score, [0.1,0.25,0.5,0.75,0.9])) AS q FROM scores_v GROUP BY grp")
def percentiles(r):
    from cohortlens.operators.ranking import quantiles

    return quantiles(r.scores, "grp", "score", [0.1, 0.25, 0.5, 0.75, 0.9])


@query("g05_density", """
SELECT *, n*25/sum(n) OVER (PARTITION BY grp)::DOUBLE AS density FROM (SELECT grp, least(floor(score*25),24)::INT AS bin, count(*) AS n FROM scores_v GROUP BY 1, 2)
""")
def density(r):
    return m.score_profile(r.scores)


@query("h01_append", "SELECT student, strm, credit, NULL::BIGINT AS source FROM enrolment_v UNION ALL SELECT student, strm, NULL, source FROM snapshot_v")
def append(r):
    return setops.append([r.enrolment.select("student", "strm", "credit"), r.snapshots.select("student", "strm", "source")])


@query("h02_intersect", MERGE + " SELECT student, strm FROM l INTERSECT SELECT student, strm FROM r")
def intersect(r):
    return setops.common(r.enrolment.select("student", "strm"), late_terms(r.snapshots))


@query("h03_except", MERGE + " SELECT student, strm FROM l EXCEPT SELECT student, strm FROM r")
def except_(r):
    return setops.without(r.enrolment.select("student", "strm"), late_terms(r.snapshots))


@query("h04_union_distinct", "SELECT count(*) AS n FROM (SELECT student, strm FROM enrolment_v UNION SELECT student, strm FROM snapshot_v)")
def union_distinct(r):
    return setops.union_count([r.enrolment.select("student", "strm"), r.snapshots.select("student", "strm")])
