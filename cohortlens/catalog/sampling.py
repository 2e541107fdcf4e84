"""Splits and samples."""

from pyspark.sql import functions as F

from cohortlens.catalog.registry import query
from cohortlens.functions.terms import nth_term
from cohortlens.operators import aggs as a
from cohortlens.operators import sampling as s
from cohortlens.operators.ranking import shuffle_order
from cohortlens.operators.setops import append


@query("k01_split_by", "SELECT (strm >= 2000)::INT AS part, count(*) AS n, sum(credit) AS credit FROM enrolment_v GROUP BY ALL")
def split_by(r):
    train, test = s.split_by(r.enrolment, F.col("strm") >= 2000)
    agg = [F.count(F.lit(1)).alias("n"), F.sum("credit").alias("credit")]
    return train.agg(F.lit(0).alias("part"), *agg).unionByName(test.agg(F.lit(1).alias("part"), *agg))


@query("k02_stratified_folds", "SELECT id, ((row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('#', id, '12345')), id) - 1) % 5)::INT AS fold FROM scores_v WHERE valid=0")
def stratified_folds(r):
    return s.stratified_folds(r.scores.where("valid = 0"), "y", "id", 5, 12345).select("id", "fold")


@query("k03_downsample", """
WITH t AS (SELECT * FROM scores_v WHERE valid=0), o AS (SELECT *, row_number() OVER (PARTITION BY grp, y ORDER BY md5(concat_ws('#', id, '4321')), id) AS rn FROM t WHERE grp <> 'afam'),
st AS (SELECT grp, y, count(*) AS n FROM o GROUP BY ALL), e AS (SELECT *, (SELECT count(*) FROM t WHERE grp='afam')*n/sum(n) OVER ()::DOUBLE AS exact FROM st),
f AS (SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY floor(exact)-exact, grp, y) AS k FROM e),
q AS (SELECT grp, y, base + CASE WHEN k <= (SELECT count(*) FROM t WHERE grp='afam') - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END AS quota FROM f)
SELECT id, grp, y FROM t WHERE grp='afam' UNION ALL SELECT o.id, o.grp, o.y FROM o JOIN q ON o.grp=q.grp AND o.y=q.y AND o.rn <= q.quota
""")
def downsample(r):
    return s.downsample(r.scores.where("valid = 0"), "grp", "y", "afam", "id", 4321).select("id", "grp", "y")


ATTENDED = """
first AS (SELECT student, min(strm) AS first FROM snapshot_v GROUP BY student),
att AS (SELECT DISTINCT student, first, CASE WHEN grp IN ('white','hisp') THEN 0 ELSE 1 END AS valid,
 (3*floor((strm-first)/10) + CASE strm-first-10*floor((strm-first)/10) WHEN 8 THEN 1 WHEN 9 THEN 2 ELSE strm-first-10*floor((strm-first)/10) END + 1)::INT AS nth
 FROM snapshot_v JOIN first USING (student) JOIN student_v USING (student)),
att17 AS (SELECT * FROM att WHERE nth <= 17),
prop AS (SELECT nth, count(*)/sum(count(*)) OVER ()::DOUBLE AS prop FROM (SELECT student, max(nth) AS nth FROM att17 GROUP BY student) GROUP BY nth)"""


def attended(r):
    """student, first, valid, nth (1-17): the consecutive numbers of the terms each student attended."""
    first = a.collapse(r.snapshots, "student", first=F.min("strm"))
    part = r.students.select("student", F.when(F.col("grp").isin("white", "hisp"), 0).otherwise(1).alias("valid"))
    terms = r.snapshots.select("student", "strm").distinct().join(first, "student").join(part, "student")
    return terms.select("student", "first", "valid", nth_term(F.col("first"), F.col("strm")).alias("nth")).where("nth <= 17").distinct()


def _proportions(att):
    return a.share(a.freq(a.collapse(att, "student", nth=F.max("nth")), "nth"), [], "n", "prop").select("nth", "prop")


@query("k04_quota_sizes", f"""
WITH {ATTENDED}, n AS (SELECT count(DISTINCT student) AS n FROM att17), r AS (SELECT nth, prop, round(prop*n) AS k, n FROM prop, n)
SELECT nth, prop, (k + CASE WHEN nth = (SELECT min(nth) FROM r) THEN n - sum(k) OVER () ELSE 0 END)::BIGINT AS sample_size FROM r
""")
def quota_sizes(r):
    att = attended(r)
    return s.quota_sizes(_proportions(att), "nth", "prop", att.agg(F.count_distinct("student")).scalar())


def _truncation_sql():
    """The 17 sequential steps as chained tables: need, free pool, taken."""
    parts = [ATTENDED, """n AS (SELECT valid, count(DISTINCT student) AS n FROM att17 GROUP BY valid)""",
             """qr AS (SELECT valid, nth, round(prop*n) AS k, n FROM prop, n)""",
             """quota AS (SELECT valid, nth, (k + CASE WHEN nth = (SELECT min(nth) FROM prop) THEN n - sum(k) OVER (PARTITION BY valid) ELSE 0 END)::BIGINT AS size FROM qr)""",
             "c18 AS MATERIALIZED (SELECT valid, 0::BIGINT AS carry FROM n)", "u18 AS MATERIALIZED (SELECT 0::BIGINT AS student, 0 AS valid, 0 AS new_nth WHERE false)"]
    for b in range(17, 0, -1):
        parts.append(f"""t{b} AS MATERIALIZED (SELECT p.student, p.valid, {b} AS new_nth, n.need, p.pool FROM (
  SELECT student, valid, row_number() OVER (PARTITION BY valid ORDER BY md5(concat_ws('#', student, '12345')), student::VARCHAR) AS rn, count(*) OVER (PARTITION BY valid) AS pool
  FROM att17 WHERE nth={b} AND student NOT IN (SELECT student FROM u{b + 1})) p
  JOIN (SELECT c.valid, c.carry + coalesce(q.size,0) AS need FROM c{b + 1} c LEFT JOIN quota q ON q.valid=c.valid AND q.nth={b}) n ON n.valid=p.valid WHERE rn <= need)""")
        parts.append(f"""c{b} AS MATERIALIZED (SELECT c.valid, (c.carry + coalesce(q.size,0)) - (SELECT count(*) FROM t{b} WHERE t{b}.valid=c.valid) AS carry
  FROM c{b + 1} c LEFT JOIN quota q ON q.valid=c.valid AND q.nth={b})""")
        parts.append(f"u{b} AS MATERIALIZED (SELECT * FROM u{b + 1} UNION ALL SELECT student, valid, new_nth FROM t{b})")
    return "WITH " + ",\n".join(parts)


def truncation(r):
    """Sampled term number per student, drawn separately for the training and the validation cohort."""
    att = attended(r)
    props = _proportions(att)
    sizes = att.groupBy("valid").agg(F.count_distinct("student").alias("n")).collect()
    parts = [s.quota_sizes(props, "nth", "prop", F.lit(row["n"])).withColumn("valid", F.lit(row["valid"])) for row in sizes]
    quotas = {row["valid"]: {} for row in sizes}
    for row in append(parts).collect():
        quotas[row["valid"]][row["nth"]] = row["sample_size"]
    return att, s.truncation_sample(att, quotas, "student", "nth", "valid", 12345)


@query("k05_truncation_sample", _truncation_sql() + " SELECT student, valid, new_nth FROM u1")
def truncation_sample(r):
    return truncation(r)[1]


@query("k06_truncation_window", _truncation_sql() + """
SELECT student, first, new_nth, CASE WHEN x%10 IN (5,6) THEN x+7 ELSE x END::INT AS last_term, (max_nth > new_nth)::INT AS truncated FROM (
 SELECT u1.student, a.first, u1.new_nth, a.max_nth, a.first + 10*floor((u1.new_nth-1)/3) + (u1.new_nth-1)%3 AS x FROM u1 JOIN (SELECT student, first, max(nth) AS max_nth FROM att17 GROUP BY ALL) a USING (student))
""")
def truncation_window(r):
    att, sampled = truncation(r)
    return s.truncation_window(sampled.select("student", "new_nth"), att, "student", "first", "nth")


@query("k06_truncation_distribution", _truncation_sql() + """
SELECT valid, new_nth, count(*)/sum(count(*)) OVER (PARTITION BY valid)::DOUBLE AS sampled, max(prop) AS wanted FROM u1 LEFT JOIN prop ON prop.nth=new_nth GROUP BY valid, new_nth
""")
def truncation_distribution(r):
    att, sampled = truncation(r)
    counts = a.share(a.freq(sampled, ["valid", "new_nth"]), "valid", "n", "sampled").drop("n")
    return counts.join(_proportions(att).withColumnsRenamed({"nth": "new_nth", "prop": "wanted"}), "new_nth", "left")


@query("k07_segment", "SELECT college, count(*) AS n, avg((grade IN ('A','B','C'))::INT) AS rate FROM enrolment_v WHERE college IN ('NATION_1','NATION_2','NATION_3','NATION_4','NATION_5') AND grade IN ('A','B','C','D','F','W') GROUP BY college")
def segment(r):
    from cohortlens.functions.grades import OUTCOME, PASSED_WELL

    e = s.segment(r.enrolment, "college", [f"NATION_{i}" for i in range(1, 6)]).where(F.col("grade").isin(OUTCOME))
    return e.groupBy("college").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("grade").isin(PASSED_WELL).cast("int")).alias("rate"))


@query("k08_shuffle", "SELECT id, row_number() OVER (ORDER BY md5(concat_ws('#', id, '54321')), id) AS position FROM scores_v")
def shuffle(r):
    return shuffle_order(r.scores, "id", 54321).select("id", "position")
