"""SimHash near-duplicates with pigeonring filtering.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 (seed 42) of its 3-word shingles. Equal fingerprints are
folded into one row before anything is compared, so groups of copies cost nothing.

The 64 bits are a ring of ``SEGMENTS`` segments. If two fingerprints differ in ``RADIUS`` bits at most, some segment starts a
chain in which, for every length l, the first l segments differ in at most l * RADIUS / SEGMENTS bits together. With five
segments and two bits this allows no difference in the first two segments, one in the first three or four, two in all five.
So the first two segments are the key under which a fingerprint is listed, once for each place on the ring, and pairs within
a list must pass the longer chains before their full distance is taken.

Lists of more than ``MOST`` fingerprints are not compared pair by pair. Their members differ only in the other segments, and
two of them are within two bits of each other exactly if some word is within one bit of both; each member is therefore filed
under itself and under each of its one-bit changes there, and all that are filed under a word are linked to the smallest of
them. That is exact too, its cost grows with the number of members and not with its square, and no cap drops a link.

A list gives a forest instead of its pairs: each fingerprint is linked to a smaller one of its group. Components come from
repeated minimum links over distributed tables (large and small stars), written to the shared folder after each round.

Defined cases: a missing text is empty; a text of one or two words is one shingle, a text of none has fingerprint zero, which
links like any other; repeated rows give a row each; rows without an id get a component but never name it, unless all of its
rows lack one; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortlens.llm.common import append, bytes_of, stored

SHINGLE, SEED, RADIUS, SEGMENTS, MOST = 3, 42, 2, 5, 128

#: Lowest bit and width of each segment of the ring.
RING = tuple((i * 64 // SEGMENTS, (i + 1) * 64 // SEGMENTS - i * 64 // SEGMENTS) for i in range(SEGMENTS))
#: Segments at the start of a chain that may not differ at all.
EXACT = max(l for l in range(1, SEGMENTS + 1) if l * RADIUS // SEGMENTS == 0)


def fingerprint(data: bytes) -> int:
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - SHINGLE + 1)
    if n == 1:
        return digest(b" ".join(words), SEED)
    counts = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 15):
        part = words[start : min(n, start + (1 << 15)) + SHINGLE - 1]
        hashes = np.array([digest(b" ".join(x), SEED) for x in zip(*(part[k:] for k in range(SHINGLE)))], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a long that has the same 64 bits; an equally named column is replaced."""
    docs = docs.drop(out)

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x) for x in bytes_of(batch, text)], np.uint64)
            yield append(batch, {out: pa.array(found.view(np.int64))})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


def ring_keys(fps: DataFrame) -> DataFrame:
    """(slot, key, fp): each fingerprint under its first two segments from each place of the ring."""
    def segment(i):
        low, width = RING[i % SEGMENTS]
        return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))

    entries = []
    for i in range(SEGMENTS):
        key = segment(i)
        for k in range(1, EXACT):
            key = F.shiftleft(key, RING[(i + k) % SEGMENTS][1]).bitwiseOR(segment(i + k))
        entries.append(F.struct(F.lit(i).alias("slot"), key.alias("key")))
    return fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.slot", "e.key", "fp")


def chain_survivors(left: np.ndarray, right: np.ndarray, slot: int) -> np.ndarray:
    """Which pairs of one list keep to the budget of every chain from ``slot`` on, the last being the full distance."""
    differ = left ^ right
    alive, spent = np.ones(len(differ), bool), np.zeros(len(differ), np.int64)
    for l in range(1, SEGMENTS + 1):
        low, width = RING[(slot + l - 1) % SEGMENTS]
        spent[alive] += np.bitwise_count((differ[alive] >> np.uint64(low)) & np.uint64((1 << width) - 1))
        alive &= spent <= l * RADIUS // SEGMENTS
    return alive


def list_forest(fps: list[int], slot: int) -> list[tuple[int, int]]:
    """Links (fingerprint, smaller one) that connect what is near within one list; a link for each member at most."""
    values = np.unique(np.array(fps, np.int64)).view(np.uint64)
    i, j = np.triu_indices(len(values), 1)
    near = chain_survivors(values[i], values[j], slot)
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i[near].tolist(), j[near].tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    signed = values.view(np.int64).tolist()
    return [(signed[x], signed[root(x)]) for x in range(len(values)) if root(x) != x]


def near_links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp``; their transitive closure is that of all pairs within RADIUS."""
    keys = ring_keys(fps)
    sizes = keys.groupBy("slot", "key").agg(F.count("*").alias("size")).where("size > 1")
    listed = stored(keys.join(sizes, ["slot", "key"]), "lists")
    small = listed.where(F.col("size") <= most).groupBy("slot", "key").agg(F.collect_list("fp").alias("fps"))

    def compare(batches):
        for batch in batches:
            links = []
            for slot, fps in zip(batch.column("slot").to_pylist(), batch.column("fps").to_pylist()):
                links += list_forest(fps, slot)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["u", "v"])

    compared = small.select("slot", "fps").mapInArrow(compare, "u bigint, v bigint")
    # Long lists: a member's own word and those one bit away, in the segments that may differ, tell who is near.
    flips = []
    for slot in range(SEGMENTS):
        bits = [low + b for k in range(EXACT, SEGMENTS) for low, width in [RING[(slot + k) % SEGMENTS]] for b in range(width)]
        signed = [0] + [(1 << b) - (1 << 64 if b == 63 else 0) for b in bits]
        flips.append(F.when(F.col("slot") == slot, F.array(*[F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in signed])))
    filed = listed.where(F.col("size") > most).select("fp", F.explode(F.coalesce(*flips)).alias("word")).distinct()
    heads = filed.groupBy("word").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = filed.join(heads, "word").where("fp > v").select(F.col("fp").alias("u"), "v")
    return compared.union(stars).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for all nodes that have a link. Each round links every node's larger
    neighbours and then its smaller ones to its smallest; the number of rounds grows with the logarithm of a component."""
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))).distinct()
        after = stored(small, "edges")
        # Done when every node has one link and no root has a link of its own: all components are stars.
        open_ = after.groupBy("u").count().where("count > 1").select("u").union(
            after.select(F.col("v").alias("u")).join(after.select("u"), "u", "left_semi")).limit(1).count()
        edges = after
        if not open_:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def groups(rows: DataFrame, doc_id: str = "doc_id", most: int = MOST) -> DataFrame:
    """``rows`` (an id and ``fp``, stored) with ``component_id``, the smallest id of the group."""
    fps = stored(rows.groupBy("fp").agg(F.min(doc_id).alias("first_id")), "fingerprints")
    roots = stored(components(near_links(fps.select("fp"), most)), "roots")
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "named")
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = named.join(names, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp")
