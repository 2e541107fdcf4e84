"""The pipeline's stages against plain versions, each on its own input."""

import brute
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402


def test_stages(spark, real):
    folder = real[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.orderBy("doc_id").collect()
    for name, stage in corpus_pipeline.STAGES[:4]:
        path = corpus_pipeline.work_folder(spark, "test")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.orderBy("doc_id").collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids, texts = [r.doc_id for r in before], [r.text for r in before]
        if name == "exact dedup":
            assert [r.doc_id for r in after] == [d for d, _, _, kept, _ in brute.exact_groups(list(zip(ids, texts))) if kept]
        if name == "SimHash near-dedup":
            assert [r.doc_id for r in after] == sorted(set(brute.components(ids, [brute.fingerprint(t) for t in texts])))
        if name.startswith("mixing"):
            assert {r.doc_id for r in after} <= set(ids) and all([r.doc_id for r in after].count(d) <= 3 for d in ids)
        before = after
    tokens = corpus_pipeline.tokens(spark, docs, folder)
    assert tokens.count() == len(before) and all(len(r.tokens) == r.n_tokens for r in tokens.collect())


def test_run_covers_all_stages(spark, real):
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"
    assert corpus_pipeline.run(spark, real[0]).count() > 0


def test_stages_decide_by_row_and_not_by_id(spark):
    words = [" ".join(f"{w}{i}" for i in range(60)) for w in ("one", "two", "three", "four", "five", "six")]
    ids = [None, None, None, 7, 7, 8]
    texts = [(d, w, "en", "a", 0) for d, w in zip(ids, words)]
    copies = [(None, words[0].upper(), "en", "a", 0), (7, words[5].upper(), "en", "a", 0), (7, words[0].title(), "en", "a", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    near = corpus_pipeline.near_dedup(spark, spark.createDataFrame(texts + copies, schema), "").collect()
    # Of each group the smallest id, a missing one last: 7 stands for the copies of one and of six.
    kept = [(None, words[1]), (None, words[2]), (7, words[3]), (7, words[4]), (7, copies[1][1]), (7, copies[2][1])]
    assert sorted((r.doc_id or 0, r.text) for r in near) == sorted((d or 0, t) for d, t in kept)
    one = [(None, f"{w} {w}", None, "a", 0) for w in words] + [(3, f"{w} b", None, "a", 0) for w in words]
    mixed = corpus_pipeline.mixing(spark, spark.createDataFrame(one, schema), "").collect()
    # One source has its own size as target: every row once.
    assert sorted((r.doc_id or 0, r.text) for r in mixed) == sorted((r[0] or 0, r[1]) for r in one)
