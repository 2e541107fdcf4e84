"""Driver tables and the records views derived from them (see FIXTURES.md)."""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.functions.nulls import first_of
from cohortlens.functions.terms import term_of_date
from cohortlens.sources.buckets import bucketed
from cohortlens.sources.scan import work_folder
from cohortlens.sources.shuffles import deal, many_partitions, size_shuffles


# Column types of the driver tables the views read; a declared schema saves a footer pass per scan.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
}


def load(spark: SparkSession, directory: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One keyed table; CSV is read with a header and as text."""
    reader = spark.read
    if fmt == "parquet" and name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    if fmt == "csv":
        return reader.csv(f"{directory}/{name}.csv", header=True, inferSchema=False)
    return reader.format(fmt).load(f"{directory}/{name}.{fmt}")


class Records:
    """Lazily derived views over one data directory. The views of many rows ask for shuffles whose number of partitions follows the rows
    (``sources/shuffles.py``), so that what a task holds doesn't grow with the tables."""

    #: Whether the enrolments and snapshots are in buckets of the student.
    dealt = False

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def by_student(self) -> "Records":
        """The same views, the enrolments and snapshots stored in buckets of the student: for jobs that read them several times. Their
        joins run once, and what groups by student (and term) is not shuffled for it again."""
        out = Records(self.spark, self.directory)
        out.lines, folder = self.lines, work_folder(self.spark)  # the number of line items sizes the buckets
        out.enrolment = bucketed(self.enrolment, f"{folder}/enrolment", "student")
        out.snapshots = bucketed(self.snapshots, f"{folder}/snapshots", "student")
        out.dealt = True
        return out

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.directory, name)

    @cached_property
    def lines(self) -> DataFrame:
        """The line items, which all large views start from; their number (from the files' footers) sizes the shuffles."""
        lines = self.table("lineitem")
        size_shuffles(self.spark, lines.count())
        return lines

    def by_order(self, lines: DataFrame) -> DataFrame:
        """Rows dealt by order, for the join with the orders, where they are many; a scan's tasks are as large as the files allow."""
        return deal(lines, "l_orderkey") if many_partitions(self.spark) else lines

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))

    @cached_property
    def enrolment(self) -> DataFrame:
        """Student x term x college x course x section."""
        l, (p, s, n) = self.lines, (self.table(t) for t in ("part", "supplier", "nation"))
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        key = F.col("l_partkey")
        number = (100 + key % 200).cast("string")
        return (
            self.by_order(
                l.join(p, key == p.p_partkey)
                .join(s, l.l_suppkey == s.s_suppkey)
                .join(n, s.s_nationkey == n.n_nationkey)
                .select(*l.columns, "n_name", F.upper(F.substring("p_type", 1, 3)).alias("subject")))
            .join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("o_custkey").alias("student"),
                term_of_date(F.col("o_orderdate")).alias("strm"),
                F.col("n_name").alias("college"),
                F.col("l_suppkey").alias("instructor"),
                "subject",
                F.when(key % 17 == 0, (1 + key % 9).cast("string"))
                .when(key % 19 == 0, F.concat(number, F.lit("L")))
                .otherwise(number).alias("course_num"),
                F.col("l_linenumber").alias("section"),
                (F.col("l_quantity") % 5).alias("credit"),
                F.when(F.col("l_suppkey") % 3 == 0, "D").when(F.col("l_suppkey") % 3 == 1, "E").otherwise("O")
                .alias("day_eve_code"),
                first_of(
                    ((flag == "R") & (status == "F"), F.lit("A")),
                    (flag == "R", F.lit("B")),
                    ((flag == "A") & (status == "F"), F.lit("C")),
                    ((flag == "A") & (F.col("l_quantity") < 25), F.lit("D")),
                    (flag == "A", F.lit("F")),
                    (status == "F", F.lit("W")),
                ).alias("grade"),
            )
        )

    @cached_property
    def students(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        return self.table("customer").select(
            F.col("c_custkey").alias("student"),
            first_of((segment == "AUTOMOBILE", "white"), (segment == "BUILDING", "afam"),
                     (segment == "FURNITURE", "hisp"), (segment == "HOUSEHOLD", "asian"), default="other").alias("grp"),
            F.col("c_nationkey").alias("home"),
            F.col("c_acctbal").alias("balance"),
            F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("gender"),
        )

    @cached_property
    def scores(self) -> DataFrame:
        """One scored row per id with its group, outcome and train/validation flag."""
        return self.orders.join(self.students, F.col("o_custkey") == F.col("student")).select(
            F.col("o_orderkey").alias("id"),
            "grp",
            F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("y"),
            (F.floor(F.col("o_totalprice") % 1000).cast("double") / 1000).alias("score"),
            F.when(F.year("o_orderdate") >= 2000, 1).otherwise(0).alias("valid"),
        )

    @cached_property
    def spells(self) -> DataFrame:
        l, (s, n) = self.lines, (self.table(t) for t in ("supplier", "nation"))
        rank = F.col("o_orderpriority")
        shipped = F.max(F.col("l_shipdate").cast("date"))
        keys = ["o_custkey", "n_name", "o_orderdate", "o_orderpriority"]
        lines = self.by_order(
            l.join(s, l.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).select("l_orderkey", "l_shipdate", "n_name"))
        rows = self.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(*keys, "l_shipdate")
        # By student once: the groups here, their terms and what is looked up for a student need no further exchange.
        return (
            (deal(rows, "o_custkey") if many_partitions(self.spark) else rows)
            .groupBy(*keys).agg(shipped.alias("shipped"))
            .select(
                F.col("o_custkey").alias("student"),
                F.col("n_name").alias("college"),
                F.least("o_orderdate", "shipped").alias("begin_date"),
                F.greatest("o_orderdate", "shipped").alias("end_date"),
                first_of((rank == "1-URGENT", 1.0), (rank == "2-HIGH", 0.75), (rank == "3-MEDIUM", 0.5),
                         (rank == "5-LOW", 0.25)).cast("double").alias("intensity"),
            )
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """Student x term source rows with demographic and program attributes."""
        key, rank = F.col("o_orderkey"), F.col("o_orderpriority")
        return self.orders.select(
            F.col("o_custkey").alias("student"),
            key.alias("source"),
            term_of_date(F.col("o_orderdate")).alias("strm"),
            F.floor(F.col("o_totalprice") % 18).cast("bigint").alias("total_credit_hrs"),
            F.when(key % 7 == 0, 1).otherwise(0).alias("dual_enrollment"),
            first_of((rank == "1-URGENT", "AA&S"), (rank == "2-HIGH", "AAS"), (rank == "3-MEDIUM", "CERT"),
                     (rank == "5-LOW", "CSC")).alias("deglvl"),
            F.when(key % 4 != 0, (20000 + key % 37).cast("string")).alias("zcta"),
            F.when(key % 5 != 0, F.col("o_totalprice") % 100).alias("distance"),
            F.when(key % 3 != 0, key % 6).alias("fhe"),
            F.when(key % 8 != 0, key % 5).alias("mhe"),
        )

    @cached_property
    def aid(self) -> DataFrame:
        """Student x year aid amounts with the credits of each term."""
        month, price = F.month("o_orderdate"), F.col("o_totalprice")
        three = lambda cond: F.sum(F.when(cond, 3).otherwise(0))
        return (
            self.orders.groupBy(F.col("o_custkey").alias("student"), F.year("o_orderdate").alias("year"))
            .agg(
                three(month <= 5).alias("credspr"),
                three((month >= 6) & (month <= 8)).alias("credsum"),
                three(month > 8).alias("credfal"),
                F.sum(F.when(F.col("o_orderstatus") == "P", price).otherwise(0.0)).alias("pell"),
                F.sum(price).alias("grants"),
            )
            .withColumn("budget", F.when(F.col("student") % 6 != 0, 1000 * (F.col("student") % 9)))
        )

    @cached_property
    def prerequisites(self) -> DataFrame:
        e = self.enrolment
        previous = (F.expr("try_cast(course_num as int)") - 1).cast("string")
        return (
            e.where((F.length("course_num") == 3) & (F.col("course_num") > "100"))
            .select(F.concat_ws("_", "subject", "course_num").alias("course"),
                    F.concat_ws("_", "subject", previous).alias("prereq"))
            .distinct()
        )
