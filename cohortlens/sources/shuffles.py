"""Numbers of shuffle partitions that follow the rows.

A session's ``spark.sql.shuffle.partitions`` is a fixed number, so a task's hash tables and sorts would grow with the tables. Adaptive
execution starts from ``initialPartitionNum`` where that is set and joins small partitions again, so a high number costs small
tables nothing.
"""

import math

from pyspark.sql import DataFrame, SparkSession

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Rows of the largest table for each partition of a shuffle, about.
ROWS_PER_TASK = 250_000


def size_shuffles(spark: SparkSession, rows: int) -> None:
    """Let shuffles of this session start from as many partitions as ``rows`` need; from the session's own number if that is enough."""
    needed = math.ceil(rows / ROWS_PER_TASK)
    if needed > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL, str(needed))
    else:
        spark.conf.unset(INITIAL)


def many_partitions(spark: SparkSession) -> int | None:
    """The number that :func:`size_shuffles` found to be needed; None if the session's own is enough."""
    n = spark.conf.get(INITIAL, None)
    return None if n is None else int(n)


def partitions(spark: SparkSession) -> int:
    return many_partitions(spark) or int(spark.conf.get("spark.sql.shuffle.partitions"))


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys``, over as many partitions as the tables need; adaptive execution sizes them where the session's own number
    is enough."""
    n = many_partitions(df.sparkSession)
    return df.repartition(*keys) if n is None else df.repartition(n, *keys)
