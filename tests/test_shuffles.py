"""The number of shuffle partitions follows the rows of the tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlens.operators.joins import spells_to_terms
from cohortlens.plans.courses import fill_grades
from cohortlens.sources import shuffles
from cohortlens.sources.tables import SCHEMAS, Records

ORDERS, LINES = 12, 3


@pytest.fixture
def tables(spark, tmp_path):
    day = lambda k: dt.datetime(1995, 1, 10) + dt.timedelta(days=40 * k)
    rows = {
        "nation": [(0, "NATION_0", 0), (1, "NATION_1", 0)],
        "supplier": [(s, f"s{s}", s % 2, 0.0) for s in range(4)],
        "part": [(k, f"p{k}", "b", "PROMO TIN", 1, 1.0) for k in range(5)],
        "orders": [(o, None if o == 5 else o % 4, "F", 10.0, day(o), "1-URGENT") for o in range(ORDERS)],
        "lineitem": [(o, (o + i) % 5, (o * i) % 4, i, float(o + i), 1.0, 0.0, 0.0, "R", "F", day(o + i)) for o in range(ORDERS) for i in range(LINES)],
    }
    for name, values in rows.items():
        spark.createDataFrame(values, SCHEMAS[name]).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    yield str(tmp_path)
    shuffles.size_shuffles(spark, 0)


def views(spark, at):
    r = Records(spark, at)
    terms = spells_to_terms(r.spells, (1990, 2009)).groupBy("student", "college", "strm").count()
    return {"enrolment": r.enrolment, "spells": r.spells, "terms": terms, "filled": fill_grades(r.enrolment)}


def test_partitions_follow_rows_and_rows_stay_the_same(spark, tables, monkeypatch):
    few = {k: sorted(map(str, v.collect())) for k, v in views(spark, tables).items()}
    assert shuffles.many_partitions(spark) is None
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(shuffles, "ROWS_PER_TASK", 1)
    many = views(spark, tables)
    n = ORDERS * LINES
    assert n > own and shuffles.many_partitions(spark) == n
    for name, df in many.items():
        assert sorted(map(str, df.collect())) == few[name]
        assert f", {n}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_terms_of_spells_need_no_exchange_after_the_students_are_dealt(spark, tables, monkeypatch):
    monkeypatch.setattr(shuffles, "ROWS_PER_TASK", 1)
    plan = views(spark, tables)["terms"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(student" not in plan and "Exchange hashpartitioning(o_custkey" in plan


def test_enrolments_in_buckets_are_the_same_and_are_not_dealt_again(spark, tables):
    from cohortlens.plans import courses as c
    from cohortlens.sources.buckets import exchanges

    plain = Records(spark, tables)
    stored = plain.by_student()
    for view in ("enrolment", "snapshots"):
        assert sorted(map(str, getattr(stored, view).collect())) == sorted(map(str, getattr(plain, view).collect()))
    same = lambda f: sorted(map(str, f(plain).collect())) == sorted(map(str, f(stored).collect()))
    assert same(lambda r: fill_grades(r.enrolment, r.dealt)) and same(lambda r: c.section_predictors(r.enrolment, r.dealt))
    assert exchanges(fill_grades(stored.enrolment, stored.dealt).groupBy("student", "strm").count()) == 0
    assert exchanges(fill_grades(plain.enrolment, plain.dealt)) > 0


def test_blocks_of_students_are_assembled_without_an_exchange(spark, tmp_path):
    from cohortlens.operators.joins import assemble_checked
    from cohortlens.sources.buckets import bucketed

    base = spark.range(40).select((F.col("id") % 7).alias("student"), F.col("id").alias("strm"), F.col("id").alias("section"))
    mine = bucketed(base.select("student", "strm", (F.col("strm") * 2).alias("a")), f"{tmp_path}/a", "student", 4)
    other = base.where("section <> 3").select("section", (F.col("section") + 1).alias("b"))
    blocks = {"mine": (mine, ["student", "strm"]), "other": (other, ["section"])}
    plain, report = assemble_checked(base, blocks, f"{tmp_path}/plain", "strm")
    dealt, found = assemble_checked(base, blocks, f"{tmp_path}/dealt", "strm", dealt_by="student")
    assert dealt.columns == plain.columns == ["section", "student", "strm", "a", "b"]
    assert sorted(dealt.collect()) == sorted(plain.collect()) and report == found and report["without other"] == 1
