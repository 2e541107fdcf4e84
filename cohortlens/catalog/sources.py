"""Scans, sinks and table contracts."""

from pyspark.sql import functions as F

from cohortlens.catalog.registry import query
from cohortlens.operators.rows import clean_text_numbers
from cohortlens.sources.contracts import assert_unique, duplicate_keys, null_counts
from cohortlens.sources.scan import scan_csv_dir, scan_snapshots, sink, work_folder
from cohortlens.sources.tables import load


@query("a01_scan_csv_dir", """
SELECT year, count(*) AS n, count(DISTINCT student) AS students, sum(credfal)::BIGINT AS credfal FROM aid_v GROUP BY year
""")
def csv_dir(r):
    """Yearly CSV files as text, tagged with the year in the file path."""
    folder = work_folder(r.spark)
    r.aid.select("student", "credfal", "year", F.col("year").alias("file_year")).write.partitionBy("file_year").csv(
        folder, header=True)
    text = scan_csv_dir(r.spark, folder, "year_tag", r"file_year=(\d{4})/")
    return text.groupBy(F.col("year_tag").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("student").alias("students"),
        F.sum(F.col("credfal").try_cast("bigint")).alias("credfal"))


@query("a02_scan_snapshots", """
SELECT student, total_credit_hrs, deglvl, (dense_rank() OVER (ORDER BY strm) - 1)::INT AS source FROM snapshot_v
""")
def snapshots(r):
    folder = work_folder(r.spark)
    r.snapshots.select("student", "total_credit_hrs", "deglvl", "strm").write.partitionBy("strm").parquet(folder)
    return scan_snapshots(r.spark, folder, ["student", "total_credit_hrs", "deglvl"], tag=r"strm=(\d+)/",
                          schema="student bigint, total_credit_hrs bigint, deglvl string")


@query("a03_load", "SELECT c_mktsegment, count(*) AS n, sum(c_nationkey)::BIGINT AS s FROM customer GROUP BY c_mktsegment")
def loaded(r):
    return load(r.spark, r.directory, "customer").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_nationkey").alias("s"))


@query("a04_clean_text_numbers", """
SELECT o_orderkey AS id, CASE WHEN t IN ('NULL') THEN NULL WHEN t = 'NA' THEN 0.0 WHEN t = 'XXXXXX' THEN 999999.0 ELSE try_cast(t AS DOUBLE) END::DOUBLE AS amount
FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'NA' WHEN 1 THEN 'NULL' WHEN 2 THEN 'XXXXXX' WHEN 3 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS t FROM orders)
""")
def clean_text(r):
    k = F.col("o_orderkey") % 5
    raw = r.orders.select(F.col("o_orderkey").alias("id"), F.when(k == 0, "NA").when(k == 1, "NULL").when(k == 2, "XXXXXX")
                          .when(k == 3, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("amount"))
    return clean_text_numbers(raw, {"amount": {"NA": "0", "NULL": None, "XXXXXX": "999999"}})


@query("a05_sink", "SELECT student, year, credfal::BIGINT AS credfal, budget::BIGINT AS budget FROM aid_v")
def sinks(r):
    return sink(r.aid.select("student", "year", "credfal", "budget"), work_folder(r.spark))


@query("a05_sink_csv", "SELECT student, year, credfal::BIGINT AS credfal, budget::BIGINT AS budget FROM aid_v")
def sinks_csv(r):
    return sink(r.aid.select("student", "year", "credfal", "budget"), work_folder(r.spark), "csv")


@query("a06_unique_contract", """
SELECT student, strm, subject, course_num, count(*) AS n_rows FROM enrolment_v GROUP BY ALL HAVING count(*) > 1
""")
def unique_contract(r):
    """The student key holds (else this raises); duplicates of the coarse enrolment key are listed."""
    assert_unique(r.students, "student")
    return duplicate_keys(r.enrolment, ["student", "strm", "subject", "course_num"])


@query("a06_null_contract", """
SELECT count(*) FILTER (WHERE zcta IS NULL) AS zcta, count(*) FILTER (WHERE distance IS NULL) AS distance,
 count(*) FILTER (WHERE deglvl IS NULL) AS deglvl, count(*) FILTER (WHERE student IS NULL) AS student FROM snapshot_v
""")
def null_contract(r):
    return null_counts(r.snapshots, ["zcta", "distance", "deglvl", "student"])
