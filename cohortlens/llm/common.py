"""Helpers that the operators share."""

import uuid
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space as the operators split it: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

_FOLDERS = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of the session (``spark.checkpoint.dir``). A session without that setting gets
    a folder in its warehouse, which driver and executors share as well. What is written there is read lazily by the
    frame that an operator returns, so it belongs to the caller, who may clear the folder when done."""
    base = spark.conf.get(_FOLDERS, None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new shared folder and read it back: later steps neither repeat the work nor depend on executors
    that may be lost."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, case ignored."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def hashed_share(column: Column, seed: int, bound: int, rows: int) -> Column:
    """True for about ``bound`` of ``rows`` rows, chosen by a hash of their id, for all of them if there are no more."""
    if rows <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(column.cast("string"), F.lit(seed)), F.lit(1 << 40)) < int((1 << 40) * bound / rows)


def append(batch: pa.RecordBatch, columns: dict) -> pa.RecordBatch:
    """``batch`` with more columns at its end."""
    names = batch.schema.names + list(columns)
    return pa.RecordBatch.from_arrays(batch.columns + list(columns.values()), names=names)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch; a missing text is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of the texts of a batch; a missing text is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def trimmed(memo: dict, most: int) -> dict:
    """``memo`` itself, or its older half once it has more than ``most`` entries: what is frequent was met early."""
    return memo if len(memo) <= most else dict(islice(memo.items(), most // 2))
