"""Tables in buckets of a key, so that later jobs join and group by it without an exchange."""

import uuid

from pyspark.sql import DataFrame

from cohortlens.sources.shuffles import partitions


def bucketed(df: DataFrame, path: str, by: str, buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """Write ``df`` in ``buckets`` buckets of ``by`` (by default as many as the tables need shuffle partitions), one sorted file each,
    and return a scan that knows them. ``path`` is a new folder that driver and executors share.

    The table is external and registered in the session's catalog under a name of its own: the files are the caller's,
    and other sessions read them by path. Rows of one key are in one bucket, so this is for keys whose rows are bounded,
    as a student's are by the calendar. ``dealt``: the rows come from such buckets and are where they belong already.
    """
    spark = df.sparkSession
    buckets = buckets or partitions(spark)
    name = f"bucketed_{uuid.uuid4().hex}"
    # The exchange deals rows as the buckets do, so that every task writes one file.
    rows = df if dealt else df.repartition(buckets, by)
    rows.write.format("parquet").bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)
    return spark.table(name)


def exchanges(df: DataFrame) -> int:
    """How many shuffles the plan of ``df`` has before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange SinglePartition")
