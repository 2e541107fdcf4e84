"""WARC archives written and read by Spark, and transactions assembled from their records.

Writing: a capture is three records, a ``response`` (or a ``revisit`` of an earlier equal payload), a ``request`` and a
``metadata`` record, the last two with ``WARC-Concurrent-To`` naming the first. Every record ends with two line ends, so an
archive is what Spark's text sink writes with these as its line separator, one gzip file a task, committed like any other
output. Equal payloads are found from digests alone; payloads move once, to meet the verdict of their row by its own key, and
never by their digest, so a payload that a third of all rows have is no hot key.

Reading: the text source with the same separator gives each archive's bytes in order (gzip files aren't split), in parts that
a task joins again and cuts by ``Content-Length``; payloads may hold the separator or whole records. Nothing but the record
being read is kept. Archives by others can be read too if they are gzip files, compressed whole or record by record.

Assembly: ``transactions`` joins request and metadata records to the response or revisit that they, or it, name as concurrent
and gives one nested row a capture. Several records of a kind for one capture count, and the one with the smallest id is shown.

Defined cases: a missing payload is empty; a missing url leaves the header out, line ends and blanks in it become %XX; rows
without an id come after all others when the response of a group is chosen; of rows equal in id and payload, the one with the
smallest key is the response; a record that isn't one raises an error with its file; archives without records give no rows;
other columns of the pages are left out of the archives.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens.llm.common import stored

#: Fixed values of the format: version, end of a record, and the profile of a revisit by payload.
VERSION, END = "WARC/1.1", "\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are stored again each time.
LEAST_BYTES = 100

RECORD = ("file string, type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, "
          "date string, payload_digest string, content_type string, http_header binary, payload binary")


def row_key() -> Column:
    """A key for each row of stored files: file and place in it. It is the same whenever the row is read."""
    return F.concat_ws("#", "_metadata.file_path", "_metadata.row_index")


def _uuid(kind: str, key: Column) -> Column:
    digest = F.md5(F.concat(F.lit(f"{kind}:"), key))
    parts = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _lines(*lines: Column) -> Column:
    """Header lines; missing ones are left out."""
    return F.concat_ws("\r\n", *lines)


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def _record(kind: Column, record_id: Column, block: Column, content_type: Column, date: str, *fields: Column) -> Column:
    head = _lines(F.lit(VERSION), _field("WARC-Type", kind), _field("WARC-Record-ID", record_id), _field("WARC-Date", F.lit(date)),
                  *fields, _field("Content-Type", content_type), _field("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(END), block)


def revisits(pages: DataFrame, key: str, page_id: str = "page_id", payload: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """(key, first): the rows whose payload an earlier row has, and the key of the row with the smallest id."""
    body = F.coalesce(F.col(payload), F.lit(""))
    prints = stored(pages.where(F.octet_length(body) >= least).select(
        F.col(key).alias("key"), F.col(page_id).alias("id"), F.unhex(F.sha2(body, 256)).alias("digest")), "payload-digests")
    first = prints.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "key")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return prints.join(first, "digest").where("key <> first.key").select("key", F.col("first.key").alias("first"))


def write(pages: DataFrame, path: str, key: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
          date: str = "1970-01-01T00:00:00Z", least: int = LEAST_BYTES) -> None:
    """Archives of ``pages`` in the new folder ``path``. ``key`` is a column that differs in every row and stays the same
    when the rows are read again (``row_key``)."""
    rows = pages.select(F.col(key).alias("key"), F.col(page_id).cast("string").alias("id"), F.col(url).alias("url"),
                        F.coalesce(F.col(payload), F.lit("")).alias("body"))
    # Stored first: Spark then knows its size, and payloads stay where they are if it is small enough to be sent to them.
    told = rows.join(stored(revisits(pages, key, page_id, payload, least), "revisits"), "key", "left")
    uri = F.regexp_replace("url", "\r", "%0D")
    for mark, code in (("\n", "%0A"), (" ", "%20"), ("\t", "%09")):
        uri = F.replace(uri, F.lit(mark), F.lit(code))
    answer = _uuid("response", F.col("key"))
    again = F.col("first").isNotNull()
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
                  _field("Content-Length", F.octet_length("body").cast("string")))
    target = _field("WARC-Target-URI", uri)
    host, tail = F.regexp_extract(uri, "^[a-zA-Z]+://([^/?#]*)", 1), F.regexp_extract(uri, "^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    place = F.when(F.startswith(tail, F.lit("/")), tail).otherwise(F.concat(F.lit("/"), tail))
    response = _record(
        F.when(again, "revisit").otherwise("response"), answer, F.concat(http, F.lit(END), F.when(again, "").otherwise(F.col("body"))),
        F.lit("application/http;msgtype=response"), date, target,
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2("body", 256))),
        F.when(again, _field("WARC-Refers-To", _uuid("response", F.col("first")))), F.when(again, F.lit(f"WARC-Profile: {SAME_PAYLOAD}")))
    request = _record(
        F.lit("request"), _uuid("request", F.col("key")),
        F.concat(_lines(F.concat(F.lit("GET "), F.coalesce(place, F.lit("/")), F.lit(" HTTP/1.1")), _field("Host", F.coalesce(host, F.lit("")))), F.lit(END)),
        F.lit("application/http;msgtype=request"), date, target, _field("WARC-Concurrent-To", answer))
    metadata = _record(
        F.lit("metadata"), _uuid("metadata", F.col("key")), F.concat(_lines(F.lit("fetchTimeMs: 0"), _field("page-id", F.col("id"))), F.lit("\r\n")),
        F.lit("application/warc-fields"), date, target, _field("WARC-Concurrent-To", answer))
    told.select(F.explode(F.array(response, request, metadata)).alias("value")).write.option("lineSep", END).option(
        "compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


class Cutter:
    """Cuts the bytes of one archive, which come in parts, into records."""

    def __init__(self, file: str):
        self.file, self.parts, self.size, self.need, self.head = file, [], 0, 0, None

    def feed(self, part: bytes):
        """Takes the next part and gives the records that it completes."""
        self.parts.append(part)
        self.size += len(part)
        while self.size and self.size >= self.need:
            data = b"".join(self.parts)
            self.parts, self.size = [data], len(data)
            if self.head is None:
                data = data.lstrip(b"\r\n")
                end = data.find(b"\r\n\r\n")
                self.parts, self.size = [data], len(data)
                if end < 0:
                    return
                self.head = self._header(data[:end])
                self.parts, self.size = [data[end + 4 :]], len(data) - end - 4
                self.need = self.length
                if not self.need:
                    yield self._record(b"")
                continue
            yield self._record(data[: self.need], data[self.need :])

    def _record(self, block: bytes, rest: bytes | None = None):
        if rest is not None:
            self.parts, self.size = [rest], len(rest)
        head, self.head, self.need = self.head, None, 0
        return head, block

    def _header(self, data: bytes) -> list[tuple[str, str]]:
        first, *lines = data.decode("utf-8", "replace").split("\r\n")
        fields = []
        for line in lines:
            if line[:1] in (" ", "\t") and fields:  # a folded line goes on with the one before
                fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
            else:
                name, _, value = line.partition(":")
                fields.append((name.strip().lower(), value.strip()))
        length = dict(fields).get("content-length", "")
        if not first.startswith("WARC/") or not length.isdigit():
            raise ValueError(f"no record in {self.file}: {first[:80]!r}")
        self.length = int(length)
        return fields

    def finish(self):
        if self.head is not None or b"".join(self.parts).strip(b"\r\n"):
            raise ValueError(f"the last record of {self.file} is cut off")


def _row(file: str, head: list[tuple[str, str]], block: bytes) -> tuple:
    fields = dict(reversed(head))  # of repeated fields the first, but for those that may repeat
    kind = fields.get("content-type", "")
    if kind.startswith("application/http"):
        http, mark, payload = block.partition(b"\r\n\r\n")
    else:
        http, payload = None, block
    return (file, fields.get("warc-type"), fields.get("warc-record-id"), [v for n, v in head if n == "warc-concurrent-to"],
            fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-payload-digest"),
            kind, http, payload)


_ARROW = pa.schema([(n, pa.string()) for n in ("file", "type", "record_id")] + [("concurrent_to", pa.list_(pa.string()))] + [
    (n, pa.string()) for n in ("refers_to", "target_uri", "date", "payload_digest", "content_type")] + [
    ("http_header", pa.binary()), ("payload", pa.binary())])


def read_records(spark: SparkSession, path: str, most: int = 1 << 24) -> DataFrame:
    """A row for each record of the gzip archives in ``path`` (columns of ``RECORD``). ``payload`` is the block of a record,
    behind the HTTP header if it has one. A task hands records on as soon as ``most`` bytes are together."""
    def run(batches):
        cutter, rows, size = None, [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)

        for batch in batches:
            files, values = batch.column("file").to_pylist(), batch.column("value")
            for file, value in zip(files, values):
                if cutter is None or cutter.file != file:
                    if cutter is not None:
                        cutter.finish()
                    cutter = Cutter(file)
                for head, block in cutter.feed(value.as_py() + END.encode()):
                    rows.append(_row(file, head, block))
                    size += len(block) + 500
                    if size > most:
                        yield made()
                        rows, size = [], 0
        if cutter is not None:
            cutter.finish()
        if rows:
            yield made()

    lines = spark.read.option("lineSep", END).option("recursiveFileLookup", "true").text(path)
    other = [f for f in lines.inputFiles() if not f.endswith(".gz")]
    if other:
        raise ValueError(f"archives must be gzip files: {other[0]}")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """(response, request, metadata, n_requests, n_metadata): a row for each response or revisit record. ``records`` has
    ``type``, ``record_id``, ``concurrent_to`` and any other columns; it is read three times, so it should be stored."""
    whole = F.struct(*records.columns)
    answers = records.where("type IN ('response', 'revisit')").select(F.col("record_id").alias("capture"), whole.alias("response"), "concurrent_to")
    sides = records.where("type IN ('request', 'metadata')").select("type", "record_id", "concurrent_to", whole.alias("side"))
    # Either record may name the other; a side that both name counts once.
    named = sides.select("type", "side", F.explode("concurrent_to").alias("capture"))
    naming = answers.select("capture", F.explode("concurrent_to").alias("record_id")).join(sides, "record_id").where(
        ~F.array_contains("concurrent_to", F.col("capture"))).select("type", "side", "capture")
    links = named.unionByName(naming)
    kinds = []
    for kind in ("request", "metadata"):
        mine = F.col("type") == kind
        kinds += [F.min_by("side", F.when(mine, F.col("side.record_id"))).alias(kind), F.count_if(mine).alias(f"n_{kind}")]
    joined = answers.drop("concurrent_to").join(links.groupBy("capture").agg(*kinds), "capture", "left")
    return joined.select("response", "request", "metadata", F.coalesce("n_request", F.lit(0)).alias("n_requests"),
                         F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))


def resolved(captures: DataFrame) -> DataFrame:
    """``captures`` of ``transactions`` (stored) with ``original``: the response itself, or for a revisit the capture whose
    record it refers to, as a struct (response, metadata); missing if the archives don't hold it."""
    own = F.struct("response", "metadata")
    first = captures.where("response.type = 'response'").withColumn("original", own)
    again = captures.where("response.type = 'revisit'")
    targets = first.select(F.col("response.record_id").alias("target"), "original")
    found = again.join(targets, F.col("response.refers_to") == F.col("target"), "left").drop("target")
    return first.unionByName(found)
