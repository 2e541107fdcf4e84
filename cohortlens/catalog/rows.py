"""Row operators: projections, filters, updates, fills."""

from pyspark.sql import functions as F

from cohortlens.catalog.registry import query
from cohortlens.functions.codes import GROUPS
from cohortlens.functions.nulls import above, below, in_list
from cohortlens.operators import rows as o


@query("b01_project", "SELECT student AS vid, strm, grade AS mark FROM enrolment_v")
def project(r):
    return o.project(r.enrolment, ["student", "strm", "grade", "credit"], drop=["credit"], rename={"student": "vid", "grade": "mark"})


@query("b02_keep_if", """
SELECT source, fhe, mhe, deglvl FROM snapshot_v WHERE coalesce(fhe < 3, false) AND coalesce(mhe > 2, true) AND coalesce(deglvl,'') NOT IN ('AAS','')
""")
def keep_if(r):
    """A missing number is above every bound and a missing string is the empty string."""
    s = r.snapshots.select("source", "fhe", "mhe", "deglvl")
    return o.keep_if(s, below(F.col("fhe"), 3) & above(F.col("mhe"), 2) & ~in_list(F.col("deglvl"), ["AAS", ""]))


@query("b03_update_if", """
SELECT student, strm, college, subject, course_num, section, CASE WHEN coalesce(grade,'') = 'W' THEN credit/2 ELSE credit END AS credit FROM enrolment_v
""")
def update_if(r):
    e = r.enrolment.select("student", "strm", "college", "subject", "course_num", "section", "credit", "grade")
    return o.update_if(e, "credit", F.col("credit") / 2, F.col("grade") == "W").drop("grade")


@query("b04_dedupe", "SELECT DISTINCT student, strm FROM enrolment_v")
def dedupe(r):
    return o.dedupe(r.enrolment.select("student", "strm"))


@query("b04_dedupe_by_key", "SELECT student, max(grp) AS grp FROM student_v JOIN orders ON student = o_custkey GROUP BY student")
def dedupe_by_key(r):
    joined = r.orders.join(r.students, F.col("o_custkey") == F.col("student")).select("student", "grp")
    return o.dedupe(joined, ["student"])


@query("b05_one_hot", """
SELECT student, (grp='afam')::INT AS grp_afam, (grp='hisp')::INT AS grp_hisp, (grp='asian')::INT AS grp_asian, (grp='other')::INT AS grp_other,
 4*(home%2) + 2*(gender='M')::INT + (balance>0)::INT + 1 AS college_type FROM student_v
""")
def one_hot(r):
    hot = o.one_hot(r.students, "grp", GROUPS, "white")
    kind = o.college_type(F.col("home") % 2, (F.col("gender") == "M").cast("int"), (F.col("balance") > 0).cast("int"))
    return hot.withColumn("college_type", kind).drop("grp", "home", "balance", "gender")


@query("b06_group_label", """
SELECT student, CASE WHEN grp IN ('white','afam','hisp','asian') THEN grp END AS grp FROM student_v WHERE grp <> 'other'
""")
def group_label(r):
    flags = GROUPS[:4]
    hot = o.one_hot(r.students, "grp", flags, prefix="is").select("student", *[F.col(f"is_{g}").alias(g) for g in flags])
    return o.group_label(hot, flags=flags).select("student", "grp")


@query("b07_drop_constant", "SELECT student, strm, credit FROM enrolment_v")
def drop_constant(r):
    e = r.enrolment.select("student", "strm", "credit", F.lit(1).alias("one"), (F.col("credit") * 0).alias("nil"))
    return o.drop_constant(e, ["strm", "credit", "one", "nil"])


@query("b08_collapse_rare", """
SELECT course, count(*) AS n FROM (SELECT CASE WHEN count(*) OVER (PARTITION BY course) < 0.0005 * count(*) OVER () THEN 'RARE' ELSE course END AS course
 FROM (SELECT subject || '_' || course_num AS course FROM enrolment_v)) GROUP BY course
""")
def collapse_rare(r):
    e = r.enrolment.select(F.concat_ws("_", "subject", "course_num").alias("course"))
    return o.collapse_rare(e, "course", 0.0005, "RARE").groupBy("course").agg(F.count(F.lit(1)).alias("n"))


@query("b09_outcome", """
SELECT student, strm, section, college, subject, course_num, (grade IN ('A','B','C'))::INT AS passed, greatest((grade='A')::INT, (credit>2)::INT) AS best
FROM enrolment_v WHERE grade IN ('A','B','C','D','F','W')
""")
def outcome(r):
    from cohortlens.functions.grades import OUTCOME, PASSED_WELL

    e = r.enrolment.where(F.col("grade").isin(OUTCOME))
    flags = e.withColumns({"a": (F.col("grade") == "A").cast("int"), "b": (F.col("credit") > 2).cast("int")})
    return flags.select("student", "strm", "section", "college", "subject", "course_num",
                        F.col("grade").isin(PASSED_WELL).cast("int").alias("passed"), o.row_max(["a", "b"]).alias("best"))


@query("b10_sentinel_encode", """
SELECT source, CASE WHEN dual_enrollment = 1 THEN distance ELSE (SELECT min(distance) FROM snapshot_v) - 1 END AS distance,
 CASE WHEN dual_enrollment = 1 THEN total_credit_hrs ELSE (SELECT min(total_credit_hrs) FROM snapshot_v) - 1 END AS total_credit_hrs FROM snapshot_v
""")
def sentinel_encode(r):
    s = r.snapshots.select("source", "distance", "total_credit_hrs", "dual_enrollment")
    return o.sentinel_encode(s, ["distance", "total_credit_hrs"], "dual_enrollment").drop("dual_enrollment")


@query("b10_sentinel_encode_train", """
SELECT source, CASE WHEN dual_enrollment = 1 THEN distance ELSE (SELECT min(distance) FROM snapshot_v WHERE strm < 2000) - 1 END AS distance FROM snapshot_v
""")
def sentinel_encode_train(r):
    s = r.snapshots.select("source", "distance", "dual_enrollment", "strm")
    return o.sentinel_encode(s, ["distance"], "dual_enrollment", F.col("strm") < 2000).select("source", "distance")


@query("b11_impute_mean", """
SELECT source, coalesce(distance, (SELECT avg(distance) FROM snapshot_v WHERE strm < 2000 AND total_credit_hrs > 0)) AS distance,
 coalesce(fhe::DOUBLE, (SELECT avg(fhe) FROM snapshot_v WHERE strm < 2000 AND total_credit_hrs > 0)) AS fhe FROM snapshot_v
""")
def impute_mean(r):
    s = r.snapshots.select("source", "distance", "fhe", "strm", "total_credit_hrs")
    filled = o.impute_mean(s, ["distance", "fhe"], F.col("strm") < 2000, F.col("total_credit_hrs") > 0)
    return filled.select("source", "distance", "fhe")


@query("b12_fill_mean", """
SELECT source, coalesce(distance, (SELECT avg(distance) FROM snapshot_v)) AS distance,
 CASE WHEN mhe IS NULL AND strm % 10 <> 3 THEN (SELECT avg(mhe) FROM snapshot_v WHERE strm % 10 <> 3)
      WHEN mhe IS NULL THEN (SELECT avg(mhe) FROM snapshot_v WHERE strm % 10 = 3) ELSE mhe::DOUBLE END AS mhe FROM snapshot_v
""")
def fill_mean(r):
    s = r.snapshots.select("source", "distance", F.col("mhe").cast("double").alias("mhe"), "strm")
    summer = F.col("strm") % 10 == 3
    filled = o.fill_mean(o.fill_mean(o.fill_mean(s, "distance"), "mhe", ~summer), "mhe", summer)
    return filled.drop("strm")


@query("b13_has_and_zero", """
SELECT source, (distance IS NOT NULL)::INT AS has_distance, coalesce(distance,0) AS distance, (fhe IS NOT NULL)::INT AS has_fhe, coalesce(fhe,0) AS fhe FROM snapshot_v
""")
def has_and_zero(r):
    return o.has_and_zero(r.snapshots.select("source", "distance", "fhe"), ["distance", "fhe"])
