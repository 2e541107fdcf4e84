"""Token alignment against a plain version, over a real table and odd texts."""

import random

import brute
import numpy as np
import pytest

tokenizers = pytest.importorskip("public_tokenizers")
from cohortlens.llm import op11_alignment as alignment, queries as q  # noqa: E402

A, B = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def both():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, SentencePieceProcessor(model_file=B)


def odd_texts():
    rng = random.Random(8)
    parts = ["a", "the", "é", "日本", " ", "  ", "\n", "\t", "<s>", "<|endoftext|>", "<0x41>", "\x1c", "\x85", "\xa0", "'s", "1", "xyz", " and",
             "\U0001f600", "ing", "\x00", "​", "ﬁ", "Å"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(300)] + ["▁ a", "a ▁b", None, "", " ", "\n"]
    return texts + ["x" * 5000, "日本語" * 900, "".join(rng.choices("01x", k=4000)), "the end", "the end", "the end"]


def test_query(spark, real, both):
    got = {r.doc_id: r for r in q.op11_alignment_measures(spark, real[0]).collect()}
    expected = brute.alignment([r[:2] for r in real[1]], *both)
    assert {d: tuple(r[n] for n in NAMES) for d, r in got.items()} == expected


def test_odd_texts_in_chunks_of_any_size(spark, both, monkeypatch):
    rows = list(enumerate(odd_texts()))
    df = spark.createDataFrame([(i, t, "mine", 7) for i, t in rows], "doc_id long, text string, digest string, n_a int").repartition(4)
    expected = brute.alignment(rows, *both)
    for long in (alignment.LONG, 3):  # groups of more links are summed by their different ids
        monkeypatch.setattr(alignment, "LONG", long)
        found = alignment.Aligner.of(A, B).align(list({p for _, t in rows if t for p in alignment.cut(" " + t)}))
        pairs = sorted((int(p), int(t)) for run in found for p, t in zip(run[6], run[7]))
        total = sum(t for _, t in pairs)
        assert long == 3 or all(t == 1 for _, t in pairs)
        if long == 3:
            assert total == before and any(t > 1 for _, t in pairs)
        before = total
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in alignment.align(df, A, B).collect()}
    assert got == expected
    assert expected[300][:6] == (0, 0, 0, 0, 0, 0) and expected[300][6] == ""


def test_small_chunks_give_the_same(spark, both):
    rows = list(enumerate(odd_texts()[:60]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = alignment.stored(alignment.chunks(df, A, B, size=20), "test")
    assert parts.count() >= 1 and parts.select("chunk").distinct().count() == parts.count()
    found = alignment.text_measures(parts, alignment.pair_counts(parts)).collect()
    expected = brute.alignment(rows, *both)
    assert sorted(r.n_links for r in found) == sorted({t: expected[i][3] for i, t in rows if t}.values())


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, A, B).collect() == []
    rows = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (2, None)], "doc_id long, text string")
    got = alignment.align(rows, A, B).collect()
    assert len(got) == 4 and {r.count_sum for r in got if r.doc_id != 2} == {3 * got[0].n_links or 3 * got[1].n_links}
    assert [tuple(r[n] for n in NAMES) for r in got if r.doc_id == 2] == [(0, 0, 0, 0, 0, 0, "")]


def test_distinct_values():
    random_ = np.random.default_rng(2)
    values = random_.integers(0, 50, 400)
    got = alignment._distinct(values, np.full(50, -1))
    assert sorted(got) == sorted(set(values.tolist()))
