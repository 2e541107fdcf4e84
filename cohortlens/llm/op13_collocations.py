"""Collocations: phrases of two or three words that stand together more often than their parts would.

Counting goes over counting quotient filters. Texts are read once, by task, into chunks: a chunk has a dictionary of its words
by language and its texts as numbers of that dictionary. The dictionaries' counts give the words that occur ``least`` times or
more; only these can be part of a candidate, and they get dense ids over all languages, so an id tells its language. Ids go
back to each chunk by a join with its dictionary, where a word stands once. A chunk's n-grams of ids are packed into numbers,
permuted invertibly (so that they spread evenly), sorted and laid down as filters, one for each shard of the permuted range:
the high bits are the quotient, told by two bitmaps (which quotients occur, where each run ends), all other bits stay as the
remainder, counters follow in slots of their own. No bit is lost, so counts are exact. Filters of a shard are merged in order
over all chunks, and the permutation is undone for what reaches ``least``. A shard has about ``SHARD`` entries at any size of
the corpus, as its number of bits follows the number of words, and an n-gram that is in every text is one entry a chunk.

Ids of ``b`` bits make n-grams of ``n * b`` bits; above 64 bits the first word goes into a second number.

Scores: a candidate of count ``a`` cut into parts of counts ``l`` and ``r`` scores floor(1e6 a a / (l r)), exactly, in decimals;
the lowest cut counts, of equal ones the earliest. Candidates that mostly occur inside one longer candidate are dropped.

Defined cases: a missing text is empty, a missing language is ``und``, apart from no language that is so named; texts of one
word, and words between marks, count as words only; repeated rows count each; ties go by count and then by the phrase's bytes;
an empty table gives an empty result; other columns are not looked at.
"""

import struct
from array import array
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.llm.common import bytes_of, stored

#: Tokens and different words of a chunk, entries of a shard before merging.
CHUNK, WORDS, SHARD = 2_500_000, 400_000, 1_000_000
LEAST, TOP, UNKNOWN = 10, 2000, "und"

#: Marks that end a piece; between them words are split at space and tab. 0xFF is in no UTF-8 text.
MARKS = b".,;:!?\x0a\x0b\x0c\x0d"
_BREAK = b"\xff"
_PLAIN = bytes(0xFF if b in MARKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Other white space of ``bytes.split`` can't be left after that: all but space and tab are marks.

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case, and a break where a piece ends."""
    return text.translate(_PLAIN).replace(_BREAK, b" \xff ").split()


def chunks(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(chunk, stream, langs, words, counts): numbers of the words, 0 for a break, as 32-bit integers; word k of the
    dictionary has number k + 1."""
    schema = "chunk bigint, stream binary, langs array<string>, words array<string>, counts array<bigint>"

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0

        def fresh():
            number = count(1).__next__
            return array("i"), defaultdict(lambda: defaultdict(number, {_BREAK: 0}))

        def row():
            pairs = sorted((i, w, g) for g, known in numbers.items() for w, i in known.items() if i)
            times = np.bincount(np.frombuffer(stream, np.int32), minlength=len(pairs) + 1)[1:]
            words = pa.array([w for _, w, _ in pairs], pa.binary()).cast(pa.string())
            values = [[part << 32 | made], [stream.tobytes()], [[g for *_, g in pairs]]]
            arrays = [pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.binary(), pa.list_(pa.string())))]
            ends = pa.array([0, len(pairs)], pa.int32())
            arrays += [pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64)))]
            return pa.RecordBatch.from_arrays(arrays, names=["chunk", "stream", "langs", "words", "counts"])

        stream, numbers = fresh()
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                rows = batch.slice(k, 200)
                for data, g in zip(bytes_of(rows, "text"), rows.column("lang").to_pylist()):
                    stream.extend(map(numbers[g].__getitem__, tokens(data)))
                    stream.append(0)
                if len(stream) > CHUNK or sum(map(len, numbers.values())) > WORDS:
                    yield row()
                    made += 1
                    stream, numbers = fresh()
        if stream:
            yield row()

    return docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang")).mapInArrow(run, schema)


def frequent_words(parts: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, lang, word, c): words counted ``least`` times or more, with ids 1, 2, ... ``parts``: stored chunks."""
    each = parts.select(F.explode(F.arrays_zip("langs", "words", "counts")).alias("e")).select("e.*")
    found = each.groupBy(F.col("langs").alias("lang"), F.col("words").alias("word")).agg(F.sum("counts").alias("c")).where(F.col("c") >= least)
    # Numbered by the task that wrote a row and the row's place in it, then moved up by the rows of the tasks before.
    rows = stored(found.withColumn("place", F.monotonically_increasing_id()), "words").withColumn("task", F.shiftright("place", 33))
    sizes = rows.groupBy("task").agg(F.count("*").alias("n"))
    before = sizes.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    return rows.join(before, "task").select((F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).alias("id"), "lang", "word", "c")


def _mix(x: np.ndarray, width: int) -> np.ndarray:
    x = (x + np.uint64(1)) * np.uint64(_ODD[0])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_ODD[1])
    return (x ^ (x >> np.uint64(32))) >> np.uint64(64 - width)


def permute(lanes: list[np.ndarray], widths: list[int], back: bool = False) -> list[np.ndarray]:
    """An invertible map of numbers of one or two lanes of the given widths (at most 63 bits each) onto themselves."""
    if len(lanes) == 2:
        first, second = lanes
        steps = [0, 1, 0]
        for step in reversed(steps) if back else steps:
            if step == 0:
                first = first ^ _mix(second, widths[0])
            else:
                second = second ^ _mix(first, widths[1])
        return [first, second]
    (x,), width = lanes, widths[0]
    mask, half = np.uint64((1 << width) - 1), np.uint64((width + 1) // 2)
    if back:
        inverse = [pow(m, -1, 1 << width) for m in _ODD]
        x = x * np.uint64(inverse[1]) & mask
        return [(x ^ (x >> half)) * np.uint64(inverse[0]) & mask]
    x = x * np.uint64(_ODD[0]) & mask
    return [(x ^ (x >> half)) * np.uint64(_ODD[1] % (1 << width)) & mask]


def pack(words: list[np.ndarray], bits: int) -> tuple[list[np.ndarray], list[int]]:
    """n-grams of ids, given by place, as lanes and their widths."""
    words = [w.astype(np.uint64) for w in words]
    lanes, widths = [], []
    if bits * len(words) > 63:
        lanes, widths, words = [words[0]], [bits], words[1:]
    last = words[0]
    for w in words[1:]:
        last = last << np.uint64(bits) | w
    return [*lanes, last], [*widths, bits * len(words)]


def unpack(lanes: list[np.ndarray], n: int, bits: int) -> list[np.ndarray]:
    """The inverse of ``pack``."""
    inner = n - (len(lanes) - 1)
    mask = np.uint64((1 << bits) - 1)
    found = [lanes[-1] >> np.uint64(bits * k) & mask for k in range(inner - 1, -1, -1)]
    return [x.astype(np.int64) for x in [*lanes[:-1], *found]]


def summed(lanes: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Numbers in ascending order, each once, with the sums of their counts. A single lane without counts is sorted in place."""
    if not len(lanes[0]):
        return lanes, np.zeros(0, np.int64)
    if counts is None and len(lanes) == 1:
        lanes[0].sort()
    else:  # stable sorting makes use of filters being in order already
        order = np.lexsort(lanes[::-1]) if len(lanes) > 1 else np.argsort(lanes[0], kind="stable")
        lanes, counts = [x[order] for x in lanes], None if counts is None else counts[order]
    new = np.ones(len(lanes[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in lanes])
    at = np.flatnonzero(new)
    sums = np.diff(np.append(at, len(new))) if counts is None else np.add.reduceat(counts, at)
    return [x[at] for x in lanes], sums


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


class QuotientFilter:
    """A counting quotient filter without empty slots, for numbers in ascending order that are only read and merged.

    ``occupied``: a bit for each quotient; ``ends``: a bit for each entry, set at the last of a quotient's run; ``slots``:
    remainders, each followed by the digits of its count less one, if there are any; ``digit``: a bit for each slot."""

    _HEAD = struct.Struct("<BBBQQ")

    def __init__(self, lanes, widths, counts):
        self.lanes, self.widths, self.counts = lanes, widths, counts

    def to_bytes(self) -> bytes:
        lanes, widths, n = self.lanes, self.widths, len(self.counts)
        top = widths[0]
        low = min(top, 8 * max(0, -(-(top - max(n, 1).bit_length()) // 8)))  # remainder bits of the first lane, whole bytes if there's room
        quotients = (lanes[0] >> np.uint64(low)).astype(np.int64)
        occupied = np.zeros(1 << (top - low), bool)
        occupied[quotients] = True
        ends = np.ones(n, bool)
        ends[:-1] = quotients[1:] != quotients[:-1]
        rests = [(lanes[0] & np.uint64((1 << low) - 1), -(-low // 8))] + [(x, -(-w // 8)) for x, w in zip(lanes[1:], widths[1:])]
        size = max(1, sum(b for _, b in rests))
        rows = np.zeros((n, size), np.uint8)
        at = 0
        for x, b in rests:
            rows[:, at : at + b] = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :b]
            at += b
        more = (self.counts - 1).astype(np.uint64)
        step = min(size, 8)
        digits = np.zeros(n, np.int64)
        rest = more.copy()
        while rest.any():
            digits += rest > 0
            rest = rest >> np.uint64(8 * step) if step < 8 else np.zeros_like(rest)
        places = np.arange(n) + np.cumsum(digits) - digits
        slots = np.zeros((n + int(digits.sum()), size), np.uint8)
        slots[places] = rows
        digit = np.ones(len(slots), bool)
        digit[places] = False
        for k in range(int(digits.max(initial=0))):
            mine = np.flatnonzero(digits > k)
            value = more[mine] >> np.uint64(8 * step * k)
            slots[places[mine] + 1 + k, :step] = value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :step]
        head = self._HEAD.pack(top, low, widths[1] if len(widths) > 1 else 0, n, len(slots))
        return b"".join([head, _bits(occupied), _bits(ends), _bits(digit), slots.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> "QuotientFilter":
        top, low, second, n, total = cls._HEAD.unpack_from(data)
        at = cls._HEAD.size

        def flags(size):
            nonlocal at
            found = np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size, bitorder="little").astype(bool)
            at += -(-size // 8)
            return found

        occupied, ends, digit = flags(1 << (top - low)), flags(n), flags(total)
        sizes = [-(-low // 8)] + ([-(-second // 8)] if second else [])
        size = max(1, sum(sizes))
        slots = np.frombuffer(data, np.uint8, total * size, at).reshape(total, size)
        places = np.flatnonzero(~digit)

        def number(rows, start, width):
            out = np.zeros((len(rows), 8), np.uint8)
            out[:, :width] = rows[:, start : start + width]
            return out.view("<u8").ravel()

        rows = slots[places]
        run = np.cumsum(ends) - ends  # of each entry
        first = np.flatnonzero(occupied)[run].astype(np.uint64) << np.uint64(low) | number(rows, 0, sizes[0])
        lanes = [first] + ([number(rows, sizes[0], sizes[1])] if second else [])
        counts, step = np.ones(n, np.int64), min(size, 8)
        of = np.flatnonzero(digit)
        if len(of):
            owner = np.cumsum(~digit)[of] - 1
            place = (of - places[owner] - 1).astype(np.uint64)
            np.add.at(counts, owner, (number(slots[of], 0, step) << (place * np.uint64(8 * step))).astype(np.int64))
        return cls(lanes, [top] + ([second] if second else []), counts)

    @classmethod
    def merged(cls, filters: list["QuotientFilter"]) -> "QuotientFilter":
        """One filter with the sums of all."""
        lanes = [np.concatenate(x) for x in zip(*(f.lanes for f in filters))]
        lanes, counts = summed(lanes, np.concatenate([f.counts for f in filters]))
        return cls(lanes, filters[0].widths, counts)

    def get(self, *number: int) -> int:
        """How often a number was counted."""
        low, high = 0, len(self.counts)
        for x, v in zip(self.lanes, number):
            low, high = low + np.searchsorted(x[low:high], np.uint64(v)), low + np.searchsorted(x[low:high], np.uint64(v), "right")
        return int(self.counts[low]) if low < high else 0


def shard_bits(words: int, partitions: int, per_shard: int = SHARD) -> int:
    return max(1, max(words // per_shard, partitions - 1).bit_length())


def chunk_filters(ids: np.ndarray, n: int, bits: int, shards: int):
    """(shard, filter) of the n-grams of a chunk's ids; 0 is no word."""
    places = [ids[k : len(ids) - n + 1 + k] for k in range(n)]
    whole = np.logical_and.reduce([p > 0 for p in places]) if len(ids) >= n else np.zeros(len(places[0]), bool)
    lanes, widths = pack([p[whole] for p in places], bits)
    del places, whole
    lanes, counts = summed(permute(lanes, widths))
    kept = widths[0] - min(shards, widths[0])
    shard = (lanes[0] >> np.uint64(kept)).astype(np.int64)
    lanes[0] = lanes[0] & np.uint64((1 << kept) - 1)
    starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
    for i, j in zip(starts, [*starts[1:], len(shard)]):
        yield int(shard[i]), QuotientFilter([x[i:j] for x in lanes], [kept, *widths[1:]], counts[i:j])


def phrase_counts(parts: DataFrame, words: DataFrame, n_words: int, distinct: int, least: int = LEAST, per_shard: int = SHARD) -> DataFrame:
    """(n, w1, w2, w3, a): ids of phrases counted ``least`` times or more; ``w3`` is 0 for pairs. ``n_words`` words are counted in
    all, ``distinct`` of them have ids."""
    bits = max(1, distinct.bit_length())
    shards = shard_bits(n_words, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), per_shard)
    entries = parts.select("chunk", F.posexplode(F.arrays_zip("langs", "words")).alias("place", "e"))
    known = entries.join(words, (F.col("e.langs") == F.col("lang")) & (F.col("e.words") == F.col("word"))).groupBy("chunk").agg(
        F.collect_list(F.struct("place", "id")).alias("known"))
    streams = parts.select("chunk", "stream", F.size("words").alias("size")).join(known, "chunk").select(
        "stream", "size", F.col("known.place").alias("places"), F.col("known.id").alias("ids"))

    def build(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                stream, size, places, ids = (batch.column(c)[k] for c in range(4))
                table = np.zeros(size.as_py() + 1, np.int64)
                table[places.values.to_numpy() + 1] = ids.values.to_numpy()
                numbers = table[np.frombuffer(stream.as_buffer(), np.int32)]
                for n in (2, 3):
                    rows, held = [], 0
                    for shard, part in chunk_filters(numbers, n, bits, shards):
                        rows.append((shard, part.to_bytes()))
                        held += len(rows[-1][1])
                        if held > 1 << 23:
                            yield _filter_rows(n, rows)
                            rows, held = [], 0
                    if rows:
                        yield _filter_rows(n, rows)

    def merge(table: pa.Table) -> pa.Table:
        n, shard = table.column("n")[0].as_py(), table.column("shard")[0].as_py()
        whole = QuotientFilter.merged([QuotientFilter.from_bytes(f.as_buffer()) for f in table.column("filter")])
        often = whole.counts >= least
        lanes = [x[often] for x in whole.lanes]
        _, widths = pack([np.zeros(0, np.int64)] * n, bits)
        lanes[0] = lanes[0] | np.uint64(shard << (widths[0] - min(shards, widths[0])))
        found = unpack(permute(lanes, widths, back=True), n, bits)
        found += [np.zeros(int(often.sum()), np.int64)] * (3 - n)
        return pa.table([pa.array(np.full(int(often.sum()), n, np.int32)), *map(pa.array, found), pa.array(whole.counts[often])],
                        names=["n", "w1", "w2", "w3", "a"])

    filters = streams.mapInArrow(build, "n int, shard int, filter binary")
    return filters.groupBy("n", "shard").applyInArrow(merge, "n int, w1 bigint, w2 bigint, w3 bigint, a bigint")


def _filter_rows(n: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n] * len(rows), pa.int32()), pa.array([s for s, _ in rows], pa.int32()),
                                       pa.array([b for _, b in rows], pa.binary())], names=["n", "shard", "filter"])


def _score(a: str, l: str, r: str):
    wide = [f"CAST({x} AS DECIMAL(19,0))" for x in (a, l, r)]
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * {wide[0]} * {wide[0]}) div ({wide[1]} * {wide[2]})")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with language, phrase, counts of the parts of the lowest cut and its score, without those that mostly
    occur inside a longer candidate. Both tables are stored."""
    def word(k):
        return words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("c").alias(f"c{k}"), *(["lang"] if k == 1 else []))

    pairs, triples = phrases.where("n = 2").select("w1", "w2", "a"), phrases.where("n = 3").select("w1", "w2", "w3", "a")
    pair = lambda a, b, c: pairs.select(F.col("w1").alias(a), F.col("w2").alias(b), F.col("a").alias(c))
    inside = triples.select(F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    longest = inside.groupBy("p").agg(F.max("a").alias("longer")).select("p.w1", "p.w2", "longer")
    two = pairs.join(longest, ["w1", "w2"], "left").where("longer IS NULL OR 100 * longer < 50 * a").join(word(1), "w1").join(word(2), "w2").select(
        "lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("c1").alias("l"), F.col("c2").alias("r"), _score("a", "c1", "c2").alias("score"))
    three = triples.join(pair("w2", "w3", "tail"), ["w2", "w3"]).join(pair("w1", "w2", "head"), ["w1", "w2"]).join(
        word(1), "w1").join(word(2).drop("c2"), "w2").join(word(3), "w3").select(
        "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", "c1", "tail", "head", "c3",
        _score("a", "c1", "tail").alias("s1"), _score("a", "head", "c3").alias("s2"))
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", "phrase", "a", F.when(early, F.col("c1")).otherwise(F.col("head")).alias("l"),
                         F.when(early, F.col("tail")).otherwise(F.col("c3")).alias("r"), F.least("s1", "s2").alias("score"))
    return two.unionByName(three)


def top(candidates: DataFrame, k: int = TOP, parts: int = 64) -> DataFrame:
    """The first ``k`` of each language: those of its hashed parts first, so that no task orders a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = candidates.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, k: int = TOP, per_shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``k`` best phrases of each language."""
    parts = stored(chunks(docs, text, lang), "chunks")
    words = stored(frequent_words(parts, least), "words")
    sums = stored(parts.select(F.explode(F.arrays_zip("langs", "counts")).alias("e")).groupBy(F.col("e.langs").alias("lang")).agg(
        F.sum("e.counts").alias("n")), "languages")
    n_words = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    phrases = stored(phrase_counts(parts, words, n_words, words.count(), least, per_shard), "phrases")
    best = top(scored(phrases, words), k)
    return best.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
