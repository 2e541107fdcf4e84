"""Collocations and their quotient filters."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import op13_collocations as coll, queries as q

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query(spark, real):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{real[0]}/documents.parquet", columns=["text", "lang"]).to_pylist()
    assert rows_of(q.op13_phrases(spark, real[0])) == brute.phrases([(r["text"], r["lang"]) for r in table])


@pytest.mark.parametrize("seed, per_shard", [(1, 1_000_000), (2, 50)])
def test_random_texts(spark, seed, per_shard):
    rng = random.Random(seed)
    words = ["A", "b", "c", "É", "é", "dd", "日本", ",", ". ", "x\ty", "\n", "\x0b", "q!", "\x1c"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", "  ", "\t"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", None, "und", ""])) for _ in range(300)]
    rows += [(None, "en"), ("", None), ("one", "fr")] + [("new york city hall", "de")] * 12 + [("york city", "de")] * 30
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("word", F.lit("mine")).withColumn("n", F.lit(0)).repartition(5)
    expected = brute.phrases(rows)
    assert rows_of(coll.collocations(df, per_shard=per_shard)) == expected and any(e[0] == "de" for e in expected)
    assert rows_of(coll.collocations(df, k=3)) == brute.phrases(rows, top=3)


def test_chunks_of_any_size_give_the_same(spark, monkeypatch):
    rows = [(f"w{i % 7} w{i % 5} w{i % 3} and so on", "en") for i in range(400)]
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    parts = coll.chunks(df).collect()
    assert len(parts) == 1 and sum(parts[0].counts) == 2400
    monkeypatch.setattr(coll, "CHUNK", 10)
    assert rows_of(coll.collocations(df)) == brute.phrases(rows)


def test_empty_table(spark):
    assert coll.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert coll.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).collect() == []


def test_exact_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000
    words = spark.createDataFrame([(1, "en", "x", big), (2, "en", "y", big + 7)], "id long, lang string, word string, c long")
    found = spark.createDataFrame([(2, 1, 2, 0, big - 3)], "n int, w1 long, w2 long, w3 long, a long")
    assert [r.score for r in coll.scored(found, words).collect()] == [1_000_000 * (big - 3) ** 2 // (big * (big + 7))]


@pytest.mark.parametrize("widths", [[1], [2], [17], [38], [57], [63], [22, 44], [31, 62], [1, 2]])
def test_the_permutation_can_be_undone(widths):
    random_ = np.random.default_rng(5)
    lanes = [random_.integers(0, 1 << w, 4000, dtype=np.uint64) for w in widths]
    mapped = coll.permute(lanes, widths)
    assert all((m < (1 << w)).all() for m, w in zip(mapped, widths))
    assert all((x == y).all() for x, y in zip(coll.permute(mapped, widths, back=True), lanes))
    if sum(widths) <= 17:  # onto itself: every number once
        whole = [np.arange(1 << widths[0], dtype=np.uint64)]
        assert len(set(coll.permute(whole, widths)[0].tolist())) == 1 << widths[0]


@pytest.mark.parametrize("bits", [1, 5, 19, 21, 22, 31])
def test_packing(bits):
    random_ = np.random.default_rng(6)
    for n in (2, 3):
        words = [random_.integers(0, 1 << bits, 500) for _ in range(n)]
        lanes, widths = coll.pack(words, bits)
        assert sum(widths) == n * bits and max(widths) <= 63
        assert all((x == y).all() for x, y in zip(coll.unpack(lanes, n, bits), words))


@pytest.mark.parametrize("widths", [[1], [7], [20], [40], [63], [22, 44], [31, 62], [8, 16]])
@pytest.mark.parametrize("size", [0, 1, 5000])
def test_filters_are_lossless_and_merge(widths, size):
    random_ = np.random.default_rng(7)
    filters, total = [], Counter()
    for k in range(3):
        lanes = [random_.integers(0, min(1 << w, 3000), size, dtype=np.uint64) for w in widths]
        counts = random_.choice([1, 1, 1, 2, 200, 300, 70_000, 1 << 40], size)
        lanes, counts = coll.summed(coll.permute(lanes, widths), counts.astype(np.int64))
        total.update(dict(zip(zip(*(x.tolist() for x in lanes)), counts.tolist())))
        data = coll.QuotientFilter(lanes, widths, counts).to_bytes()
        back = coll.QuotientFilter.from_bytes(data)
        assert back.widths == widths and (back.counts == counts).all() and all((x == y).all() for x, y in zip(back.lanes, lanes))
        filters.append(back)
    whole = coll.QuotientFilter.merged(filters)
    assert dict(zip(zip(*(x.tolist() for x in whole.lanes)), whole.counts.tolist())) == total
    assert all(whole.get(*k) == c for k, c in list(total.items())[:200])
    assert whole.get(*[(1 << w) - 1 for w in widths]) == total.get(tuple((1 << w) - 1 for w in widths), 0)


def test_filters_are_compact():
    keys = np.random.default_rng(3).integers(0, 1 << 57, 100_000, dtype=np.uint64)
    lanes, counts = coll.summed([keys])
    # 57 bits and a count of 64 in five bytes and four bits: five bytes of remainder, three bitmaps.
    assert len(coll.QuotientFilter(lanes, [57], counts).to_bytes()) < 5.8 * len(keys)


@pytest.mark.parametrize("bits", [4, 25])
def test_filters_of_a_chunk(bits):
    random_ = np.random.default_rng(9)
    ids = random_.integers(0, 14, 3000)
    for n in (2, 3):
        expected = Counter(tuple(ids[i : i + n].tolist()) for i in range(len(ids) - n + 1) if ids[i : i + n].all())
        parts = list(coll.chunk_filters(ids, n, bits, 3))
        assert sum(int(f.counts.sum()) for _, f in parts) == sum(expected.values())
        found, (_, widths) = Counter(), coll.pack([np.zeros(0, np.int64)] * n, bits)
        for shard, f in parts:
            lanes = [f.lanes[0] | np.uint64(shard << (widths[0] - 3)), *f.lanes[1:]]
            words = coll.unpack(coll.permute(lanes, widths, back=True), n, bits)
            found.update(dict(zip(zip(*(w.tolist() for w in words)), f.counts.tolist())))
        assert found == expected
    assert list(coll.chunk_filters(ids[:1], 2, bits, 3)) == []
