"""Multi-file scans and sinks."""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def scan_csv_dir(spark: SparkSession, path: str, tag: str = "year", pattern: str = r"(\d{4})[^/]*\.csv$") -> DataFrame:
    """All CSV files of a directory as text, exact duplicates within a file dropped, each row tagged
    with the year in its file name."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.select("*", F.regexp_extract("_metadata.file_path", pattern, 1).cast("int").alias(tag)).distinct()


def scan_snapshots(spark: SparkSession, paths, cols, out: str = "source", fmt: str = "parquet",
                   tag: str = r"([^/]+)$", schema=None) -> DataFrame:
    """Snapshot files of one schema, projected and numbered from 0 in the order of their tag (by default
    the file name). The number of files, not of rows, bounds the ranked table."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(paths).select(*cols, F.regexp_extract("_metadata.file_path", tag, 1).alias("__tag"))
    numbered = df.select("__tag").distinct().withColumn(
        out, (F.dense_rank().over(Window.orderBy("__tag")) - 1).cast("int"))
    return df.join(numbered, "__tag").drop("__tag")


def sink(df: DataFrame, path: str, fmt: str = "parquet", partition_by=(), mode: str = "overwrite") -> DataFrame:
    """Write a table and return a scan of what was written; the new lineage starts at the files."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    reader = df.sparkSession.read.format(fmt).schema(df.schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one the session names (``spark.checkpoint.dir``), else in its warehouse, which driver
    and executors share as well. The caller owns what is written there."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder the session names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint(eager=True)
