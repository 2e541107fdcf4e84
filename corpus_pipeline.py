"""A corpus from raw documents to token ids, in stages that are written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the columns
of ``docs`` as they came. Rows are dropped by their text's verdict alone, never by a sample.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm import op04_simhash, op06_mixing, op07_exact_dedup, op09_bpe, op10_kneser_ney
from cohortlens.llm.common import fresh, stored, table, work_folder
from cohortlens.llm.queries import BYTE_BPE, vocabulary

#: SQL can't express the language model, XXH64 or BPE.
ORACLE_SQL = None


def numbered(docs: DataFrame, number: str) -> DataFrame:
    """``docs``, written with a number for each row: ids may be missing or repeated, and a number that is computed again
    may be another one."""
    return stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the threshold of their language."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return op10_kneser_ney.judge(docs, labels).where("kept").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    return op07_exact_dedup.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies the row with the smallest id."""
    number, place = fresh(docs, "number_", "place_")
    rows = numbered(docs, number)
    # Ids may be missing or repeated: a row's place is its id, a missing one last, and then its number.
    placed = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("doc_id"), F.col(number).alias("number"))
    prints = op04_simhash.with_fingerprint(rows.select(number, "doc_id", "text")).select(placed.alias(place), "fp")
    found = op04_simhash.groups(stored(prints, "fingerprints"), place)
    first = found.where(F.col(place) == F.col("component_id")).select(F.col(f"{place}.number").alias(number))
    return rows.join(first, number, "left_semi").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    number, times, n = fresh(docs, "number_", "times_", "n_")
    rows = numbered(docs, number)
    sized = stored(rows.select(number, "doc_id", "source", op06_mixing.words().alias("size"), op06_mixing.quality().alias("quality"),
                               op06_mixing.tie().alias("tie")), "sized")
    mixed = op06_mixing.sample(sized).where("epochs > 0").select(number, F.col("epochs").alias(times))
    joined = rows.join(mixed, number)
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(n)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of the text that they decode to."""
    coded = op09_bpe.encode_and_decode(docs.select("doc_id", "text"), vocabulary(BYTE_BPE)).drop("text")
    return op09_bpe.digests(coded.withColumn("tokens", F.col("ids"))).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "tokens")


STAGES = [("quality classifier", quality), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup),
          ("mixing sources to target weights", mixing), ("BPE encoding and decoding", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    for name, stage in STAGES:
        path = work_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
