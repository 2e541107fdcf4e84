"""Exact duplicates by a cuckoo-filter index of digests.

A text's digest is the SHA-256 of the text with each run of white space replaced by one space. A cuckoo filter holds a 16-bit
tag for each live digest in one of two buckets of four slots; beside each slot stands which stored digest it means. A tag
that is met is verified against the digest in its slot, so a false hit never merges two texts. When an insertion finds no
place after ``KICKS`` moves the table is doubled and filled again from the stored digests. Deletion removes a digest's slot.

On Spark each task first folds its own rows with an index of its own (a group of copies leaves a task as one row), the folded
rows are dealt by digest over shards, and each shard is folded by one more index. A shard is handed over in parts of at most
``PART`` digests, so an index has a bounded size whatever the shard holds: within a shard rows are sorted by digest, and a
part ends between two digests. The kept row of a group is the one with the smallest id.

Defined cases: a missing text counts as empty; rows without an id are kept only if no row of the group has one; of rows equal
in text and id one is kept; an empty table gives an empty result.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.common import SPACE_CLASS, fresh, stored

SLOTS, KICKS, PART = 4, 200, 100_000


class CuckooIndex:
    """Live digests (bytes of 32) with insertion, look-up and deletion; each has a number, the place of its payload."""

    def __init__(self, buckets: int = 1024):
        self.digests: list[bytes | None] = []
        self.free: list[int] = []
        self.resized = 0
        self._clear(buckets)

    def __len__(self):
        return len(self.digests) - len(self.free)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1  # a power of two
        self.tags = [0] * (buckets * SLOTS)
        self.means = [0] * (buckets * SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ (tag * 0x5BD1E995 & self.mask)

    def _slot(self, digest: bytes) -> int:
        tag, first, second = self._places(digest)
        tags, means, digests = self.tags, self.means, self.digests
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if tags[slot] == tag and digests[means[slot]] == digest:
                    return slot
        return -1

    def find(self, digest: bytes) -> int:
        """The digest's number, or -1."""
        slot = self._slot(digest)
        return self.means[slot] if slot >= 0 else -1

    def insert(self, digest: bytes) -> tuple[int, bool]:
        """The digest's number and whether it is new."""
        known = self.find(digest)
        if known >= 0:
            return known, False
        if self.free:
            number = self.free.pop()
            self.digests[number] = digest
        else:
            number = len(self.digests)
            self.digests.append(digest)
        if not self._place(number):
            self._grow()
        return number, True

    def delete(self, digest: bytes) -> int:
        """Removes a live digest and returns its number, or -1 if it isn't there."""
        slot = self._slot(digest)
        if slot < 0:
            return -1
        number, self.tags[slot] = self.means[slot], 0
        self.digests[number] = None
        self.free.append(number)
        return number

    def _place(self, number: int) -> bool:
        tag, bucket, second = self._places(self.digests[number])
        for b in (bucket, second):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.tags[slot]:
                    self.tags[slot], self.means[slot] = tag, number
                    return True
        for kick in range(KICKS):
            slot = bucket * SLOTS + (number + kick) % SLOTS
            tag, self.tags[slot] = self.tags[slot], tag
            number, self.means[slot] = self.means[slot], number
            bucket = self._other(bucket, tag)
            for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.tags[s]:
                    self.tags[s], self.means[s] = tag, number
                    return True
        return False

    def _grow(self) -> None:
        """Twice the buckets, filled from the stored digests; again if one finds no place."""
        buckets = 2 * (self.mask + 1)
        while True:
            self._clear(buckets)
            self.resized += 1
            if all(self._place(i) for i, d in enumerate(self.digests) if d is not None):
                return
            buckets *= 2


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE_CLASS + "+", " ")


def digest(text: str = "text") -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


class _Folded:
    """An index with the smallest id and the number of rows of each digest."""

    def __init__(self):
        self.index, self.least, self.rows = CuckooIndex(), [], []

    def add(self, digest: bytes, least, rows: int) -> None:
        number, new = self.index.insert(digest)
        if new:
            self.least.append(least)
            self.rows.append(rows)
        else:
            self.rows[number] += rows
            if self.least[number] is None or least is not None and least < self.least[number]:
                self.least[number] = least

    def batch(self, id_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.index.digests, pa.binary()), pa.array(self.least, id_type), pa.array(self.rows, pa.int64())],
            names=["digest", "keep_id", "group_size"])


def _fold(batches):
    """Folds rows (digest, keep_id, group_size); when an index is full it is handed on at the next new digest, so that in
    sorted rows a digest is never split."""
    folded, last, kind = _Folded(), None, pa.int64()
    for batch in batches:
        kind = batch.column("keep_id").type
        for d, least, rows in zip(*(batch.column(c).to_pylist() for c in ("digest", "keep_id", "group_size"))):
            if len(folded.index) >= PART and d != last:
                yield folded.batch(kind)
                folded = _Folded()
            folded.add(d, least, rows)
            last = d
    if len(folded.index):
        yield folded.batch(kind)


def groups(digests: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """From rows (id, ``digest``): a row for each digest with ``keep_id`` and ``group_size``."""
    kind = digests.schema[doc_id].dataType.simpleString()
    schema = f"digest binary, keep_id {kind}, group_size bigint"
    rows = digests.select("digest", F.col(doc_id).alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    dealt = rows.mapInArrow(_fold, schema).repartition("digest").sortWithinPartitions("digest")
    return dealt.mapInArrow(_fold, schema)


def mark(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``rows`` (an id, ``digest``; stored) with ``keep_id``, ``group_size`` and ``kept``; of rows equal in both columns
    one is kept. Rows of a large group are joined to one row, which adaptive execution splits."""
    row, first = fresh(rows, "row_", "first_")
    numbered = stored(rows.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = stored(groups(numbered, doc_id), "groups")
    # The kept row: among those that bear the kept id (few, and spread over all digests) the first one.
    own = numbered.select(F.col("digest").alias("d"), F.col(doc_id).alias("i"), row)
    heads = own.join(found, (F.col("d") == F.col("digest")) & F.col("i").eqNullSafe(F.col("keep_id")))
    heads = heads.groupBy("digest").agg(F.min(row).alias(first))
    return numbered.join(found.join(heads, "digest"), "digest").withColumn("kept", F.col(row) == F.col(first)).drop(row, first)


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One whole row of each group of equal texts, the columns as they came. The join on (digest, id) spreads a large group
    over its ids, and rows equal in both meet in the same task without another shuffle."""
    d, k = fresh(docs, "digest_", "keep_")
    digests = stored(docs.select(F.col(doc_id).alias("doc_id"), digest(text).alias("digest")), "digests")
    found = groups(digests, "doc_id").select(F.col("digest").alias(d), F.col("keep_id").alias(k))
    marked = docs.withColumn(d, digest(text))
    other = fresh(marked, "other_")[0]
    found = found.withColumnRenamed(d, other)
    joined = marked.join(found, (F.col(d) == F.col(other)) & F.col(doc_id).eqNullSafe(F.col(k)))
    return joined.dropDuplicates([d, doc_id]).select(*docs.columns)


def removed(found: DataFrame, gone: DataFrame, left: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Groups after rows are taken out: ``found`` as ``groups`` gives them, ``gone`` and ``left`` rows (id, ``digest``) that
    go and that stay. Digests that no row holds any more leave the index, others get their new size and smallest id."""
    touched = gone.select("digest").distinct()
    again = groups(left.join(touched, "digest", "left_semi"), doc_id).select(
        F.col("digest").alias("d"), F.col("keep_id").alias("new_id"), F.col("group_size").alias("new_size"))
    old = found.join(touched.withColumn("touched", F.lit(True)), "digest", "left").join(again, F.col("digest") == F.col("d"), "left")

    def run(batches):
        index = CuckooIndex()
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                index.insert(r["digest"])
            for r in rows:
                if r["touched"] and r["new_size"] is None:
                    index.delete(r["digest"])
            live = [r for r in rows if index.find(r["digest"]) >= 0]
            for r in rows:
                index.delete(r["digest"])
            yield pa.RecordBatch.from_arrays([
                pa.array([r["digest"] for r in live], pa.binary()),
                pa.array([r["new_id"] if r["touched"] else r["keep_id"] for r in live], batch.column("keep_id").type),
                pa.array([r["new_size"] if r["touched"] else r["group_size"] for r in live], pa.int64())],
                names=["digest", "keep_id", "group_size"])

    kind = found.schema["keep_id"].dataType.simpleString()
    return old.mapInArrow(run, f"digest binary, keep_id {kind}, group_size bigint")
