"""The registered queries: each applies its operator to its whole table and returns its full result."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm import (op01_toxicity, op02_quality_rules, op03_token_files, op04_simhash, op05_personal_data, op06_mixing,
                            op07_exact_dedup, op08_suffix_tree, op09_bpe, op10_kneser_ney, op11_alignment, op12_warc as warc,
                            op13_collocations)
from cohortlens.llm.common import id_crc, stored, table, work_folder
from cohortlens.llm.oracle import ORACLE_SQL  # noqa: F401  registered by __spark_entry__

BYTE_BPE, WORD_BPE, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text").withColumn("held_out", id_crc() % 5 == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(id_crc() % 5 != 0)
    model = op01_toxicity.fit(docs.where("NOT held_out").drop("held_out"), labels)
    scored = op01_toxicity.score(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = stored(op02_quality_rules.with_features(table(spark, sf_dir).select("doc_id", "text")).drop("text"), "features")
    model = op02_quality_rules.fit_label_model(features)
    return op02_quality_rules.with_verdict(features, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "token-files")
    op03_token_files.write_files(table(spark, sf_dir), path, vocabulary(WORD_BPE))
    found = op03_token_files.read_documents(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return op03_token_files.with_starts(found, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(op04_simhash.with_fingerprint(table(spark, sf_dir).select("doc_id", "text")).drop("text"), "fingerprints")
    return op04_simhash.groups(rows).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op05_personal_data.find(table(spark, sf_dir).select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in op05_personal_data.BASE],
                        F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("all_spans").alias("spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = stored(table(spark, sf_dir).select(
        "doc_id", "source", op06_mixing.words().alias("size"), op06_mixing.quality().alias("quality"), op06_mixing.tie().alias("tie")), "sized")
    return op06_mixing.sample(sized).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir).select("doc_id", op07_exact_dedup.digest().alias("digest"))
    return op07_exact_dedup.mark(rows).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text").withColumn("held_out", id_crc() % 7 == 2)
    training = docs.where("NOT held_out").select("text")
    words = stored(op08_suffix_tree.word_counts(training), "words")
    tree = op08_suffix_tree.fit(training, words)
    return op08_suffix_tree.score(docs, tree, words)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = op09_bpe.encode_and_decode(table(spark, sf_dir).select("doc_id", "text"), vocabulary(BYTE_BPE)).drop("text")
    return op09_bpe.digests(tokens).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text", "lang")
    judged = op10_kneser_ney.judge(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged.select("doc_id", "perplexity", "threshold", "kept")


def op11_alignment_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_alignment.align(table(spark, sf_dir).select("doc_id", "text"), vocabulary(BYTE_BPE), vocabulary(PIECES))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "archives")
    warc.write(table(spark, sf_dir, "pages").select("*", warc.row_key().alias("row_key")), path, "row_key")
    # What the result needs of each record: the payloads of responses as digest and length, fields of the metadata as they are.
    records = warc.read_records(spark, path).select(
        "type", "record_id", "concurrent_to", "refers_to", "payload_digest", F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("sha256"), F.when(F.col("type") == "metadata", F.col("payload").cast("string")).alias("fields"))
    captures = stored(warc.transactions(stored(records, "records")), "captures")

    def page(metadata: str):
        return F.regexp_extract(f"{metadata}.fields", r"(?m)^page-id: (-?[0-9]+)", 1).try_cast("long")

    again = F.col("response.type") == "revisit"
    return warc.resolved(captures).select(
        page("metadata").alias("page_id"), F.col("original.response.payload_bytes").alias("payload_bytes"),
        F.when(again, F.substring_index("response.payload_digest", ":", -1)).otherwise(F.col("response.sha256")).alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.when(again, page("original.metadata")).alias("refers_to"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_collocations.collocations(table(spark, sf_dir).select("text", "lang"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_quality_rules, op3_token_files, op4_simhash, op5_personal_data, op6_mixing, op7_exact_dedup,
    op8_suffix_tree, op9_bpe, op10_quality_model, op11_alignment_measures, op12_warc, op13_phrases, pipeline)}
