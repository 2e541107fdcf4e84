import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(os.path.dirname(HERE))]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CARD, PHONE = "4111 1111 1111 1111", "+1 (743) 555-3824"


@pytest.fixture(scope="session")
def rows():
    """Missing values, empty and very long texts, ties, repeated rows and copies."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(40_000))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today."), (2, None), (3, ""), (4, " \n\t "),
        (5, "The  quick brown fox\njumps over the lazy dog near the river bank today."), (6, long), (7, long + " end"), (8, "x" * 30_000),
        (9, f"Mail a.b@c.de, a@@b.c or x@y, card {CARD}, ip 10.0.0.256 or 10.0.0.25, call {PHONE}."), (10, "one two"), (11, "ONE TWO"),
        (12, "a b c d e f a b c d e f a b c d e\n\nsame line\nsame line\n"), (13, "<|endoftext|> don't  é日本 \U0001f600 \x1c\x85"),
        (14, "The quick brown fox jumps over the lazy dog near the river bank today."), (15, "#*$%&|<> " * 20)]
    sources = ["b", "a", None]
    return [(i, t, None if i % 4 == 0 else "en", sources[i % 3], 0) for i, t in texts]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real():
    """The smallest table of documents, as (doc_id, text, source) in order, with its folder."""
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.001"
    t = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    return folder, sorted((r["doc_id"], r["text"], r["source"]) for r in t)
