"""Language-model scores by a probabilistic suffix tree over words.

A text is its lower-cased words and one end. The tree's states are the empty context and contexts of one to ``depth`` words
(the start of a text counts as a word there). All training texts are counted:

- the root has the count of every word; an absolute discount from the counts of counts gives a share to unknown words;
- every sequence of words that occurs ``least_count`` times, a number that doesn't depend on the corpus, is a candidate as a
  context and as an entry, a next symbol listed with a context;
- a candidate is retained if the divergence of its next symbols from those of the longest retained shorter context, times
  its count, exceeds what its entries cost; listed symbols have discounted frequencies, and the rest is the shorter
  context's distribution scaled to the probability that is left. Each state's distribution sums to one.

A text is scored from the longest retained suffix at each position. The counts and the whole model are tables: the sequences
of one length are joined with those that are a word shorter. Words and sequences that make up at least ``hot`` of the corpus
(a bounded number) go to every task; all others stay in tables that grow with the corpus. As logarithms add up, each sequence
of a text has a weight of its own there (a context's scale, an entry's distance from what the scale gives), which is joined and
added, so scores don't depend on what is hot. A filter of bounded size keeps sequences that surely have no weight, or
surely are too rare, from being shuffled. Words that are not hot are known by 62 bits of a digest in sequences (by themselves
in the root's counts), and sequences by 64 bits in the last join.

Defined cases: a missing text is empty; an empty text is its end alone; rows without an id are trained on as id ''; repeated
rows count and are scored each; with no training text all words are unknown and the score is that of V = 0; an empty table
gives an empty result.
"""

import hashlib
import math
from collections import Counter
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortlens.llm.common import append, bytes_of, stored

END = b""
FLUSH = 400_000
TOKENS = 700_000
FILTER_BITS = 27
COLD = 1 << 62


@dataclass(frozen=True)
class Settings:
    depth: int = 2
    hot: float = 2e-7
    least_count: int = 3
    discount: float = 0.5
    entry_cost: float = 0.5


@dataclass
class Level:
    """Hot contexts of one length: ``keys`` (shorter context's number * symbols + last word), ascending; a context's number is
    its place. ``log_rest``: logarithm of the scale of the shorter context's distribution. ``entries`` (context * symbols +
    next word, ascending) and ``values``, logarithms of probabilities: the hot entries of retained contexts."""

    keys: np.ndarray
    retained: np.ndarray
    log_rest: np.ndarray
    entries: np.ndarray
    values: np.ndarray


@dataclass
class Tree:
    """``words``: hot symbols 1, 2, ... by falling count; 0 is any other word, ``len(words) + 1`` the start of a text.
    ``weights``: (key, weight) of the sequences that aren't hot, ``filter`` the bits of their keys, ``hot`` the weights of
    those of two or more words that are."""

    words: list[bytes]
    counts: np.ndarray
    n: int
    v: int
    discount: float
    levels: list[Level] = field(default_factory=list)
    filter: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint64))
    hot: "Lookup | None" = None
    weights: DataFrame | None = None

    @property
    def symbols(self) -> int:
        return len(self.words) + 2

    def log_root(self, c):
        """Natural logarithm of the root's probability of a word that was counted ``c`` times."""
        unknown = max(self.discount * self.v, 1.0) / max(self.n, 1)
        return np.where(c > 0, np.log(np.maximum(c - self.discount, 1e-9) / max(self.n, 1)), math.log(min(1.0, unknown)))

    def log_base(self, c):
        return np.log10((c + 1) / (self.n + self.v + 1))


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in ascending ``keys``; -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def code_of(word: bytes) -> int:
    """The symbol of a word that isn't hot."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") & (COLD - 1) | COLD


def symbols_of(batch: pa.RecordBatch, text: str, place: dict) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Symbols of all texts of a batch with their ends (``code_of`` those that aren't hot), where each text begins, and the
    words."""
    words = [x.lower().split() for x in bytes_of(batch, text)]
    lengths = np.array([len(w) + 1 for w in words])
    get, end = place.get, place.get(END) or code_of(END)
    flat, cold = [], {}
    for w in words:
        flat += [get(t) or cold.get(t) or cold.setdefault(t, code_of(t)) for t in w]
        flat.append(end)
    return np.array(flat, np.int64), np.cumsum(lengths) - lengths, words


def before(x: np.ndarray, starts: np.ndarray, start: int) -> np.ndarray:
    """What stands before each position; ``start`` at the beginning of a text."""
    out = np.empty(len(x), np.int64)
    out[1:] = x[:-1]
    out[starts] = start
    return out


def sequences(x: np.ndarray, starts: np.ndarray, start: int, words: int) -> list[np.ndarray]:
    """For each position that many symbols, its own last; -1 before the start of a text."""
    out = [x]
    for k in range(1, words):
        out.insert(0, before(out[0], starts, start if k == 1 else -1))
    return out


def extended(keys: np.ndarray | None, symbols: np.ndarray) -> np.ndarray:
    """64 bits for sequences, from those of the sequences without the first symbol and the first symbols."""
    x = symbols.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    if keys is not None:
        x ^= keys
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def digest(parts: list[np.ndarray]) -> np.ndarray:
    return reduce(extended, parts[::-1], None)


@dataclass
class Lookup:
    """Values by key in a table with linear probing; no key is 0."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> "Lookup":
        size = 1 << max(4, math.ceil(math.log2(2 * len(keys) + 1)))
        out, slot, open_ = cls(np.zeros(size, np.uint64), np.zeros(size)), keys & np.uint64(size - 1), np.arange(len(keys))
        while len(open_):
            free = open_[out.keys[slot[open_]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            out.keys[slot[free[first]]], out.values[slot[free[first]]] = keys[free[first]], values[free[first]]
            open_ = open_[out.keys[slot[open_]] != keys[open_]]
            slot[open_] = (slot[open_] + np.uint64(1)) & np.uint64(size - 1)
        return out

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where absent, and where they are present."""
        last = np.uint64(len(self.keys) - 1)
        slot, values, present, open_ = keys & last, np.zeros(len(keys)), np.zeros(len(keys), bool), None
        while open_ is None or len(open_):
            there = self.keys[slot]
            hit, other = there == keys, there != 0
            other &= ~hit
            at = np.flatnonzero(hit) if open_ is None else open_[hit]
            values[at], present[at] = self.values[slot[hit]], True
            open_ = np.flatnonzero(other) if open_ is None else open_[other]
            keys, slot = keys[other], (slot[other] + np.uint64(1)) & last
        return values, present


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False where a key surely isn't in the filter."""
    cell = keys & np.uint64(64 * len(bits) - 1)
    return (bits[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)


def keyed(table: DataFrame, words: int) -> DataFrame:
    """With ``key``, the digest of the symbols g0, g1, ..."""
    def run(batches):
        for batch in batches:
            keys = digest([np.array(batch.column(k), np.int64) for k in range(words)])
            yield append(batch, {"key": pa.array(keys.view(np.int64))})

    columns = [f"g{k}" for k in range(words)]
    table = table.select(*columns, *(c for c in table.columns if c not in columns))
    return table.mapInArrow(run, T.StructType([*table.schema.fields, T.StructField("key", T.LongType())]))


def filter_of(table: DataFrame) -> np.ndarray:
    """A filter of the keys of a stored table: 16 bits for each, but 2 ** FILTER_BITS at most; with more keys, more others pass."""
    size = 1 << min(FILTER_BITS, max(10, math.ceil(math.log2(16 * table.count() + 1))))
    cell = F.col("key").bitwiseAND(F.lit(size - 1))
    found = table.groupBy(F.shiftright(cell, 6).alias("number")).agg(
        F.expr("bit_or(shiftleft(1L, cast(key & 63 AS int)))").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[np.array(found["number"], np.int64)] = np.array(found["bits"], np.int64).view(np.uint64)
    return out


def small(batches, rows: int = 1000):
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all words and ends. Tasks hand on sums; their dictionaries are bounded."""
    def run(batches):
        counts = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

        for batch in small(batches):
            for x in bytes_of(batch, text):
                counts.update(x.lower().split())
            counts[END] += batch.num_rows
            if len(counts) > FLUSH:
                yield rows()
                counts.clear()
        if counts:
            yield rows()

    return docs.select(text).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def sequence_counts(docs: DataFrame, shared, text: str, words: int, least: int) -> DataFrame:
    """(g0, g1, ..., c): sequences of that many symbols that occur at least ``least`` times. The tree's filter has those that
    are a word shorter."""
    def counted(x, starts, tree):
        start, m = tree.symbols - 1, tree.symbols
        # Whether the shorter sequences that end at each position may be frequent enough.
        codes = sequences(x, starts, start, words - 1)
        cold = np.flatnonzero(x >= COLD)
        if words == 2:
            frequent = np.ones(len(x), bool)
            frequent[cold] = passes(tree.filter, digest([x[cold]]))
        else:
            frequent = passes(tree.filter, digest(codes)) & (codes[0] >= 0)
        used = frequent & before(frequent, starts, words == 2).astype(bool)
        others, number = np.unique(x[cold], return_inverse=True)
        x[cold] = m + number
        m += len(others)
        parts = [p[used] for p in sequences(x, starts, start, words)]
        if m ** words < 1 << 63:
            packed = parts[0]
            for p in parts[1:]:
                packed = packed * m + p
            packed, c = np.unique(packed, return_counts=True)
            parts = [packed // m ** k % m for k in range(words - 1, -1, -1)]
        else:
            parts, c = np.unique(np.stack(parts), axis=1, return_counts=True)
        symbols = np.concatenate([np.arange(start + 1), others])
        return pa.RecordBatch.from_arrays([*(pa.array(symbols[p]) for p in parts), pa.array(c)], names=names)

    def run(batches):
        tree = shared.value
        place = {w: i for i, w in enumerate(tree.words, 1)}
        kept, size = [], 0

        def rows():
            shift = np.cumsum([0] + [len(x) for x, _ in kept[:-1]])
            return counted(np.concatenate([x for x, _ in kept]), np.concatenate([s + k for (_, s), k in zip(kept, shift)]), tree)

        for batch in small(batches, 250):
            x, starts, _ = symbols_of(batch, text, place)
            kept.append((x, starts))
            size += len(x)
            if size > TOKENS:
                yield rows()
                kept, size = [], 0
        if kept:
            yield rows()

    columns = [f"g{k}" for k in range(words)]
    names = [*columns, "c"]
    # Most sequences are new to a task: they are shuffled in order, which packs well, and only summed then.
    return docs.select(text).mapInArrow(run, ", ".join(f"{c} bigint" for c in names)).repartition(*columns).groupBy(*columns).agg(
        F.sum("c").alias("c")).where(F.col("c") >= least)


def with_states(found: DataFrame, shorter: DataFrame, depth: int, n: int, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """From counted sequences of ``depth`` words and a next one, and those a word shorter (g0, ..., c, p): the retained contexts
    (g0, ..., total, rest), rest being the logarithm of the scale, and the sequences with p, the logarithm of the probability of
    the last symbol, and ``entry``, its distance from what the scale gives (null: not listed)."""
    context, last = [f"g{k}" for k in range(depth)], [F.col(f"g{k}").alias(f"g{k + 1}") for k in range(depth)]
    joined = found.join(shorter.select(*context, F.col("c").alias("total")), context).join(
        shorter.select(*last, F.col("p").alias("parent")), [f"g{k + 1}" for k in range(depth)])
    log_p = F.log(F.greatest(F.col("c") - settings.discount, F.lit(1e-9)) / F.col("total"))
    # Entries that the shorter context already predicts aren't listed.
    joined = stored(joined.withColumn("log_p", log_p).withColumn("listed", F.abs(F.col("log_p") - F.col("parent")) > 0.05), "candidates")
    sums = joined.where("listed").groupBy(*context, "total").agg(
        F.sum(F.exp("log_p")).alias("own"), F.sum(F.exp("parent")).alias("theirs"), F.sum("c").alias("seen"),
        F.sum(F.col("c") * (F.col("log_p") - F.col("parent"))).alias("gain"), F.count("*").alias("entries"))
    left = [F.log(F.least(F.greatest(1 - F.col(c), F.lit(1e-6)), F.lit(1.0))) for c in ("own", "theirs")]
    cost = settings.entry_cost * math.log(max(n, 2)) * (1 + F.col("entries"))
    contexts = stored(sums.withColumn("rest", left[0] - left[1]).where(
        (F.col("gain") + (F.col("total") - F.col("seen")) * F.col("rest") > cost) & (F.col("own") < 1 - 1e-6) & (F.col("theirs") < 1 - 1e-6)).select(
        *context, "total", "rest"), "contexts")
    entry = F.when(F.col("listed"), F.col("log_p") - F.col("parent") - F.col("rest"))
    return contexts, joined.join(contexts.drop("total"), context, "left").withColumn("entry", entry).select(
        *found.columns, (F.col("parent") + F.coalesce("rest", F.lit(0.0)) + F.coalesce("entry", F.lit(0.0))).alias("p"), "entry")


def number_of(tree: Tree, parts: list[np.ndarray]) -> np.ndarray:
    """Numbers of hot contexts."""
    out = find(tree.levels[0].keys, parts[0])
    for level, p in zip(tree.levels[1:], parts[1:]):
        out = find(level.keys, out * tree.symbols + p)
    return out


def columns_of(table: DataFrame, words: int, *more: str) -> list[np.ndarray]:
    found = table.select(*(f"g{k}" for k in range(words)), *more).toArrow()
    return [c.to_numpy() for c in found.columns]


def log_prob(tree: Tree, states: list[np.ndarray], symbol: np.ndarray) -> np.ndarray:
    """Log probabilities of listed symbols given the numbers of their contexts by length; a symbol 0 gets only the scales
    that the root's probability is to be multiplied with."""
    out, open_ = np.zeros(len(symbol)), np.ones(len(symbol), bool)
    for k in range(len(states) - 1, -1, -1):
        level = tree.levels[k]
        at = np.flatnonzero(open_ & (states[k] >= 0))
        at = at[level.retained[states[k][at]]]
        entry = find(level.entries, states[k][at] * tree.symbols + symbol[at])
        hit = entry >= 0
        out[at[hit]] += level.values[entry[hit]]
        open_[at[hit]] = False
        out[at[~hit]] += level.log_rest[states[k][at[~hit]]]
    root = np.concatenate([[0.0], tree.log_root(tree.counts), [0.0]])
    out[open_] += root[symbol[open_]]
    return out


def fit(docs: DataFrame, words: DataFrame, settings: Settings = Settings(), text: str = "text") -> Tree:
    """``words``: the stored result of ``word_counts(docs)``. The driver gets words, contexts and entries above a fixed share
    of the corpus, so their number has a fixed bound; the tree's ``weights`` are a table of all others."""
    s = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"),
                  F.expr("count_if(c = 1)").alias("n1"), F.expr("count_if(c = 2)").alias("n2")).first()
    n = s["n"]
    discount = s["n1"] / (s["n1"] + 2 * s["n2"]) if s["n1"] and s["n2"] else 0.5
    least, hot = settings.least_count, max(settings.least_count, math.ceil(settings.hot * n))
    top = words.where(F.col("c") >= hot).orderBy(F.desc("c"), "word").toArrow()
    tree = Tree([bytes(w) for w in top["word"].to_pylist()], np.array(top["c"], np.float64), n, s["v"], discount)
    if not n:
        return tree
    start, context = tree.symbols - 1, docs.sparkSession.sparkContext
    shared = context.broadcast(tree)
    table = stored(keyed(symbol_counts(words.where(F.col("c") >= least), shared).withColumn(
        "p", F.log((F.col("c") - discount) / n)), 1), "sequences")
    shared.unpersist()
    number = np.append(np.arange(1, len(tree.words) + 1)[[w != END for w in tree.words]], start)
    keys, weights = number, []
    starts = words.where(F.length("word") == 0).select(F.lit(start).cast("long").alias("g0"), "c", F.lit(0.0).alias("p"))
    for depth in range(1, settings.depth + 1):
        tree.filter = filter_of(table)
        shared = context.broadcast(tree)
        found = sequence_counts(docs, shared, text, depth + 1, least)
        shorter = table.drop("key", "entry")
        shorter = shorter.unionByName(starts) if depth == 1 else shorter
        contexts, found = with_states(found, shorter, depth, n, settings)
        shared.unpersist()
        # A sequence has its weight as an entry and its weight as a context.
        weights.append(weighted(table, contexts, depth, hot))
        table = stored(keyed(found, depth + 1), "sequences")
        # The hot part of the level.
        level = Level(keys, np.zeros(len(keys), bool), np.zeros(len(keys)), np.zeros(0, np.int64), np.zeros(0))
        tree.levels.append(level)
        top = contexts.where(F.col("total") >= hot) if depth > 1 else contexts.where((F.col("total") >= hot) | (F.col("g0") == start))
        *parts, rest = columns_of(top, depth, "rest")
        at = number_of(tree, parts)
        level.retained[at], level.log_rest[at] = True, rest
        *parts, p, entry = columns_of(table.where(F.col("c") >= hot), depth + 1, "p", "entry")
        numbers = number_of(tree, parts[:-1]) * tree.symbols + parts[-1]
        order = np.argsort(numbers)
        listed = order[~np.isnan(entry[order])]
        level.entries, level.values = numbers[listed], p[listed]
        # Longer contexts; nothing follows an end.
        ends = [i for i, w in enumerate(tree.words, 1) if w == END]
        keys = numbers[order][~np.isin(parts[-1][order], ends)]
        if not len(numbers) and table.isEmpty():
            break
    weights.append(weighted(table, None, len(tree.levels) + 1, hot))
    found = stored(reduce(DataFrame.unionByName, (w.select("key", "weight", (F.col("c") >= hot).alias("hot")) for w in weights)), "weights")
    tree.weights, top = found.where("NOT hot").drop("hot"), found.where("hot").drop("hot").toArrow()
    tree.filter, tree.hot = filter_of(tree.weights), Lookup.of(*(c.to_numpy().view(t) for c, t in zip(top.columns, (np.uint64, np.float64))))
    return tree


def symbol_counts(words: DataFrame, shared) -> DataFrame:
    """(g0, c): counted words as symbols."""
    def run(batches):
        place = {w: i for i, w in enumerate(shared.value.words, 1)}
        for batch in batches:
            symbols = [place.get(w) or code_of(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(symbols, pa.int64()), batch.column(1)], names=["g0", "c"])

    return words.select("word", "c").mapInArrow(run, "g0 bigint, c bigint")


def weighted(table: DataFrame, contexts: DataFrame | None, words: int, hot: int) -> DataFrame:
    """The sequences of that many words that have a weight (their own as an entry and that of the context that they are) or are
    hot. Hot words' scales are in the tree."""
    entry = F.coalesce("entry", F.lit(0.0)) if words > 1 else F.lit(0.0)
    if contexts is not None:
        columns = [f"g{k}" for k in range(words)]
        table = table.join(contexts.drop("total"), columns, "left" if words > 1 else "inner")
        entry = entry + F.coalesce("rest", F.lit(0.0))
    table = table.withColumn("weight", entry)
    return table.where((F.col("weight") != 0) & (F.col("c") < hot) | (F.col("c") >= hot if words > 1 else F.lit(False)))


_SCORED = "held_out boolean, n_tokens bigint, known bigint, base double, score double, words array<binary>, times array<int>, keys array<bigint>"


def log_probs(x: np.ndarray, starts: np.ndarray, tree: Tree, depth: int) -> tuple[np.ndarray, pa.ListArray]:
    """For each text the logarithm of its probability as far as it is hot, without the root's share in other words, and the keys
    of its other sequences that may have a weight."""
    hot = np.where(x < COLD, x, 0)
    weight = np.concatenate([[0.0], tree.log_root(tree.counts), [0.0]])
    total = np.zeros(len(x))
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

    def cold(at, found):
        at, found = at[passed := passes(tree.filter, found)], found[passed]
        keys.append(found)
        owners.append(np.searchsorted(starts, at, "right") - 1)

    if depth:
        first = tree.levels[0]
        weight[first.keys[first.retained]] += first.log_rest[first.retained]
        total[starts] = weight[tree.symbols - 1]
        parts, key = sequences(x, starts, tree.symbols - 1, depth + 1), extended(None, x)
        at = np.flatnonzero(x >= COLD)
        cold(at, key[at])
        for p in parts[-2::-1]:
            key = extended(key, p)
            values, present = tree.hot.get(key)
            inside = p >= 0
            total += np.where(inside, values, 0.0)
            at = np.flatnonzero(inside & ~present)
            cold(at, key[at])
    total += weight[hot]
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    offsets = np.append(0, np.cumsum(np.bincount(owners, minlength=len(starts))))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[np.argsort(owners, kind="stable")].view(np.int64)))
    return np.add.reduceat(total, starts), lists


def score(docs: DataFrame, tree: Tree, words: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """From ``docs`` (an id, a text and ``held_out``): the id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    Rare words of a text and the keys of its sequences are stored with it, and the joins with ``words`` and the tree's
    ``weights`` start from there."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(tree, weights=None, levels=tree.levels[:1]))
    kind, depth = docs.schema[doc_id].dataType, len(tree.levels)

    def run(batches):
        tree = shared.value
        place = {w: i for i, w in enumerate(tree.words, 1)}
        counts = np.concatenate([[0.0], tree.counts, [0.0]])
        base = tree.log_base(counts)
        for batch in small(batches, 250):
            x, starts, texts = symbols_of(batch, text, place)
            logs, keys = log_probs(x, starts, tree, depth)
            x = np.where(x < COLD, x, 0)
            rare = [Counter([t for t in w if t not in place]) for w in texts]
            if END not in place:
                for c in rare:
                    c[END] = 1
            sums = [np.add.reduceat(v, starts) for v in ((x > 0).astype(np.int64), np.where(x > 0, base[x], 0.0))]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("held_out"), pa.array([len(w) + 1 for w in texts], pa.int64()),
                pa.array(sums[0]), pa.array(sums[1]), pa.array(logs / math.log(10)),
                pa.array([list(c) for c in rare], pa.list_(pa.binary())), pa.array([list(c.values()) for c in rare], pa.list_(pa.int32())), keys],
                names=["id", "held_out", "n_tokens", "known", "base", "score", "words", "times", "keys"])

    schema = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL(_SCORED).fields])
    rows = stored(docs.select(F.col(doc_id).alias("id"), text, "held_out").mapInArrow(run, schema).withColumn(
        "row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("e")).select(
        "row", F.col("e.words").alias("word"), F.col("e.times").alias("times"))
    c = F.coalesce(F.col("c"), F.lit(0)).cast("double")
    n, v, d = float(max(tree.n, 1)), float(tree.v), tree.discount
    unknown = float(tree.log_root(np.zeros(1))[0]) / math.log(10)
    parts = rare.join(words, "word", "left").select(
        "row", F.when(c > 0, F.col("times")).otherwise(0).cast("long").alias("more_known"),
        (F.col("times") * F.log10((c + 1) / (tree.n + v + 1))).alias("more_base"),
        (F.col("times") * F.when(c > 0, F.log10((c - d) / n)).otherwise(unknown)).alias("more_score"))
    if tree.weights is not None:
        parts = parts.unionByName(rows.select("row", F.explode("keys").alias("key")).join(tree.weights, "key").select(
            "row", F.lit(0).cast("long").alias("more_known"), F.lit(0.0).alias("more_base"),
            (F.col("weight") / math.log(10)).alias("more_score")))
    parts = parts.groupBy("row").agg(*(F.sum(m).alias(m) for m in ("more_known", "more_base", "more_score")))
    zero = F.lit(0)
    return rows.drop("words", "times", "keys").join(parts, "row", "left").select(
        F.col("id").alias(doc_id), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"), F.lit(tree.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero)).alias("score"))
