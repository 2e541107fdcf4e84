"""WARC archives: round trips, records by others, transactions, odd rows."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import op12_warc as warc
from cohortlens.llm.common import stored, work_folder

SCHEMA = "page_id long, url string, html string, key string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, f"k{i:04d}") for i, r in enumerate(rows)], SCHEMA)


def written(spark, df):
    path = work_folder(spark, "test")
    warc.write(df, path, "key")
    return path


def captures(spark, path):
    return warc.resolved(stored(warc.transactions(stored(warc.read_records(spark, path), "test")), "test")).collect()


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(4)
    marks = ["\r", "\n", "\r\n", "\r\n\r\n", "a", "é", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "\x00", "日本", " "]
    bodies = ["".join(rng.choices(marks, k=rng.randint(0, 40))) for _ in range(150)] + ["", None, "\r\n\r\n" * 60, "x" * 300_000, "y" * 100, "z" * 99]
    rows = [(i, f"http://h{i}.example/a b?q={i}#f", b) for i, b in enumerate(bodies)]
    rows += [(1000 + i, None, "y" * 100) for i in range(5)] + [(2000, "http://x\r\nWARC-Type: evil", "z" * 99), (2001, "", "z" * 99)]
    rows += [(None, "u", "y" * 100), (None, None, None), (7, "again", bodies[7]), (1000, None, "y" * 100)]
    return rows


def test_every_payload_comes_back(spark, odd):
    found = captures(spark, written(spark, pages(spark, odd).withColumn("file", F.lit("mine")).repartition(3)))
    assert len(found) == len(odd) and all(c.n_requests == c.n_metadata == 1 for c in found)
    full = [(bytes(c.metadata.payload).decode(), bytes(c.original.response.payload), c.response.payload_digest) for c in found]
    page = lambda fields: fields.split("page-id: ")[1].strip() if "page-id: " in fields else None
    expected = [(None if i is None else str(i), (b or "").encode()) for i, _, b in odd]
    assert sorted([(page(m), p) for m, p, _ in full], key=repr) == sorted(expected, key=repr)
    assert all(d == "sha256:" + hashlib.sha256(p).hexdigest() for _, p, d in full)


def test_revisits_refer_to_the_smallest_id(spark, odd):
    df = pages(spark, odd)
    keys = {f"k{i:04d}": r for i, r in enumerate(odd)}
    got = {r.key: r.first for r in warc.revisits(df, "key").collect()}
    groups = {}
    for k, (i, _, b) in keys.items():
        if len((b or "").encode()) >= 100:
            groups.setdefault(b, []).append((i is None, i or 0, k))
    assert got == {k: min(g)[2] for g in groups.values() for _, _, k in g if k != min(g)[2]}
    found = captures(spark, written(spark, df))
    assert sum(c.response.type == "revisit" for c in found) == len(got)
    assert all(c.response.payload == b"" and bytes(c.response.http_header).startswith(b"HTTP/1.1 200") for c in found if c.response.type == "revisit")
    assert not any((c.response.target_uri or "").count("\n") for c in found)


def test_empty_tables(spark):
    path = written(spark, pages(spark, [(1, "u", "x")]).where("page_id > 1"))
    assert warc.read_records(spark, path).count() == 0 and captures(spark, path) == []


def member(kind, record_id, block, *more):
    head = "".join(f"{line}\r\n" for line in ("WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", *more, f"Content-Length: {len(block)}"))
    return gzip.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n")


def test_archives_by_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\nmore"
    parts = [
        member("warcinfo", "<i>", b"software: x\r\n"), member("request", "<q>", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http"),
        member("response", "<r>", http, "Content-Type: application/http; msgtype=response", "WARC-Concurrent-To: <q>", "WARC-Concurrent-To: <m>", "X-Folded: a", " b"),
        member("metadata", "<m>", b"k: v", "WARC-Concurrent-To: <r>"), member("metadata", "<m2>", b"", "warc-concurrent-to: <r>"),
        member("response", "<alone>", b""), member("revisit", "<lost>", b"", "WARC-Refers-To: <gone>")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    path = f"file://{tmp_path}"
    records = {r.record_id: r for r in warc.read_records(spark, path, most=1).collect()}
    assert len(records) == 7 and records["<r>"].payload == b"body\r\n\r\nmore" and records["<r>"].concurrent_to == ["<q>", "<m>"]
    found = {c.response.record_id: c for c in captures(spark, path)}
    assert set(found) == {"<r>", "<alone>", "<lost>"}
    whole, alone, lost = found["<r>"], found["<alone>"], found["<lost>"]
    assert (whole.request.record_id, whole.metadata.record_id, whole.n_requests, whole.n_metadata) == ("<q>", "<m2>", 1, 2)  # of two the smaller id
    assert alone.request is None and alone.n_metadata == 0 and lost.original is None


@pytest.mark.parametrize("data", [b"nothing of the kind\r\n\r\n", gzip.decompress(member("response", "<r>", b"abc"))[:-8]])
def test_damaged_archives_name_their_file(spark, tmp_path, data):
    (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(data))
    with pytest.raises(Exception, match="bad.warc.gz"):
        warc.read_records(spark, f"file://{tmp_path}").collect()


def test_archives_must_be_compressed(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\n")
    with pytest.raises(ValueError, match="gzip"):
        warc.read_records(spark, f"file://{tmp_path}")
