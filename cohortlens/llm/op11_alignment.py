"""Alignment of two tokenizers' tokens: which ids of one stand for which ids of the other.

Equal texts are folded first, by the whole text, into one row with its multiplicity; each distinct text is tokenised and
aligned once. Text 'x' is read as ' x'. Tokens of both tokenizers have byte ranges in it; where tokens of both end is a
border, and what lies between two borders is a group. All pairs of an A token and a B token of a group are linked.

A task works through its texts in chunks. Both tokenizers end a token wherever a space follows something that is no white
space, so texts are cut there into pieces, and a chunk encodes and aligns each different piece once: all new pieces of a batch
go to the libraries together, and borders, groups and links come from arrays of byte offsets. A chunk is stored as one row:
the pieces' links as places in the chunk's list of id pairs, its texts as numbers of pieces, and for each pair the documents
(multiplicities included) that hold it. From these lists Spark sums the pairs' corpus-wide counts and the highest of each A id,
and joins them back with the chunks' lists, where a pair stands once. Measures of a text are sums over its pieces; they reach the
documents through a join by the text's digest.

Groups without a shared border can be long; the pairs of a long one come from its different ids and how often they occur.

Defined cases: missing and empty texts, and texts that the tokens of A or B don't give back byte by byte (a U+2581, for one,
comes back as a space) have no tokens, zeros and ''; repeated rows count as documents and get a row each, as rows without an id
do; an empty table gives an empty result; other columns are not looked at.
"""

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import stored
from cohortlens.llm.op09_bpe import PATTERN, byte_letters

#: Bytes of text, and different pieces, of a chunk; links of a group from which it is summed by its different ids.
CHUNK, PIECES, LONG = 8 << 20, 200_000, 1 << 12
_CUT = regex.compile(r"(?<=\S)(?=\x20)", regex.V1)
_RUN = regex.compile(r"\s\x20")


def cut(text: str) -> list[str]:
    """Pieces of a text that begins with a space."""
    if _RUN.search(text):
        return _CUT.split(text)
    return [" " + x for x in text.split(" ")[1:]]


class ByteLevel:
    """Tokenizer A: a byte-level BPE file of the tokenizers library whose merges make its ids in order; added tokens in a text
    are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = byte_letters(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        made = [ranks[bytes(letters[c] for c in x + y)] for x, y in pairs]
        if sorted(ranks.values()) != sorted(i for b, i in ranks.items() if len(b) == 1) + made:
            raise ValueError("merges don't make the ids in order")
        self.bytes = {i: b for b, i in ranks.items()}
        self.encoding = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.int64)


class Pieces:
    """Tokenizer B: a sentencepiece model that puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = {i: bytes([int(t[1:-1], 16)]) if self.model.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)}
        # Pieces can be cut before a space only if no token goes on there.
        self.cuts = not any("▁" in t.lstrip("▁") for t in names)

        self.lead = self.model.encode("x") if self.cuts else []

    def encode(self, text: str) -> np.ndarray:
        # A word before the text, since the model puts a space before the first word but not before nothing.
        ids = self.model.encode("x" + text if self.cuts else text[1:])
        return np.array(ids[len(self.lead) :], np.int64)


class Aligner:
    """Both tokenizers, with what a worker needs of them in arrays."""

    _known: dict = {}

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.sizes, self.names, self.joined = [], [], []
        for t in (self.a, self.b):
            size = np.zeros(max(t.bytes) + 1, np.int64)
            size[list(t.bytes)] = [len(x) for x in t.bytes.values()]
            self.sizes.append(size)
        # Decimal ids with what follows them: ',' or '|' after a token of A; ',', ';' or a line end (of a piece) after one of B.
        self.base = 2 * len(self.sizes[0])
        self.words = [f"{i}{x}" for i in range(len(self.sizes[0])) for x in ",|"] + [f"{i}{x}" for i in range(len(self.sizes[1])) for x in (",", ";", "\n")]

    @classmethod
    def of(cls, path_a: str, path_b: str) -> "Aligner":
        key = (path_a, path_b)
        if key not in cls._known:
            cls._known[key] = cls(*key)
        return cls._known[key]

    def _back(self, which: int, ids: np.ndarray) -> bytes:
        return b"".join(map((self.a, self.b)[which].bytes.__getitem__, ids.tolist()))

    def tokens(self, pieces: list[str]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """Pieces with the ids of A and B, many pieces at once where they can stand beside each other; ids are empty where the
        bytes don't come back."""
        # What ends in white space would run into the next one; single pieces may also be whole texts that can't be cut.
        alone = [p for p in pieces if p[-1:].isspace() or len(p) > 2000 or not self.b.cuts or "▁" in p]
        apart = set(alone)
        rest = [p for p in pieces if p not in apart]
        out, todo = [], [[p] for p in alone] + [rest[k : k + 2000] for k in range(0, len(rest), 2000)]
        while todo:
            some = todo.pop()
            text = "".join(some)
            raw = text.encode()
            found = [t.encode(text) for t in (self.a, self.b)]
            if all(self._back(k, ids) == raw for k, ids in enumerate(found)):
                out.append((some, *found))
            elif len(some) == 1:
                out.append((some, found[0][:0], found[1][:0]))
            else:
                todo += [some[: len(some) // 2], some[len(some) // 2 :]]
        return out

    def align(self, pieces: list[str]) -> list[tuple]:
        """For each run of ``tokens``: the pieces, and by piece n_a, n_b, n_groups, the groups as text, and its links as (number of
        the piece, pair, times). ``n_a`` is 0 for a piece that has no tokens."""
        out = []
        for some, a, b in self.tokens(pieces):
            if not len(a):
                zeros = np.zeros(len(some), np.int64)
                out.append((some, zeros, zeros, zeros, [""] * len(some), zeros[:0], zeros[:0], zeros[:0]))
                continue
            ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
            stops = np.cumsum([len(p.encode()) for p in some])
            common = np.intersect1d(ends_a, ends_b, assume_unique=True)
            group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
            piece = np.searchsorted(stops, common)  # of each group
            n_a, n_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
            last_a, last_b = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
            # Groups as text: tokens of A, then of B, group by group.
            mark_a = np.zeros(len(a), np.int64)
            mark_a[last_a] = 1
            mark_b = np.zeros(len(b), np.int64)
            mark_b[last_b] = 1
            mark_b[last_b[np.append(piece[1:] != piece[:-1], True)]] = 2
            order = np.empty(len(a) + len(b), np.int64)
            order[np.arange(len(a)) + (last_b - n_b + 1)[group_a]] = 2 * a + mark_a
            order[np.arange(len(b)) + (last_a + 1)[group_b]] = self.base + 3 * b + mark_b
            texts = "".join(map(self.words.__getitem__, order.tolist())).split("\n")[:-1]
            owner, pair, times = self._links(a, b, n_a, n_b, last_a, last_b, piece)
            size = len(some)
            out.append((some, np.bincount(piece[group_a], minlength=size), np.bincount(piece[group_b], minlength=size),
                        np.bincount(piece, minlength=size), texts, owner, pair, times))
        return out

    @staticmethod
    def _links(a, b, n_a, n_b, last_a, last_b, piece):
        long = np.flatnonzero(n_a * n_b > LONG)
        n_b = n_b.copy()
        long_b = n_b[long]
        n_b[long] = 0  # those are done on their own below
        group = np.repeat(np.arange(len(n_a)), n_a)
        width = n_b[group]
        left = np.repeat(np.arange(len(a)), width)
        first = np.cumsum(width) - width
        right = np.arange(len(left)) - first[left] + (last_b + 1 - n_b)[group[left]]
        owners, pairs, times = [piece[group[left]]], [a[left] << 32 | b[right]], [np.ones(len(left), np.int64)]
        for g, size_b in zip(long.tolist(), long_b.tolist()):
            x, x_times = np.unique(a[last_a[g] + 1 - n_a[g] : last_a[g] + 1], return_counts=True)
            y, y_times = np.unique(b[last_b[g] + 1 - size_b : last_b[g] + 1], return_counts=True)
            pairs.append((x[:, None] << 32 | y[None, :]).ravel())
            times.append((x_times[:, None] * y_times[None, :]).ravel())
            owners.append(np.full(len(x) * len(y), piece[g]))
        order = np.argsort(owner := np.concatenate(owners), kind="stable")
        return owner[order], np.concatenate(pairs)[order], np.concatenate(times)[order]


class Chunk:
    """Texts of one task until they are stored, with the pieces that they are made of."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.number, self.texts, self.size = aligner, {}, [], 0
        self.n_a, self.n_b, self.n_groups = (array("q") for _ in range(3))
        self.groups, self.links, self.times, self.lengths = [], [], [], array("q")
        self.pairs: dict[int, int] = {}
        self.docs = np.zeros(1 << 12, np.int64)
        self.rows: list[tuple] = []
        self.stream: list[np.ndarray] = []

    def learn(self, pieces: list[str]) -> None:
        for some, n_a, n_b, n_groups, texts, owner, pair, times in self.aligner.align(pieces):
            start = len(self.number)
            self.number.update(zip(some, range(start, start + len(some))))
            for mine, values in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups)):
                mine.frombytes(np.ascontiguousarray(values, np.int64).tobytes())
            self.groups += texts
            distinct, at = np.unique(pair, return_inverse=True)
            pairs = self.pairs
            places = np.array([pairs.setdefault(p, len(pairs)) for p in distinct.tolist()], np.int64)
            self.links.append(places[at].astype(np.int32) if len(at) else np.zeros(0, np.int32))
            self.times.append(times)
            self.lengths.frombytes(np.bincount(owner, minlength=len(some)).astype(np.int64).tobytes())

    def add(self, texts: list[str], digests: list[bytes], copies: list[int]) -> None:
        """``texts`` aren't empty."""
        parts = [cut(" " + t) if self.aligner.b.cuts else [" " + t] for t in texts]
        known = self.number
        new = {p for part in parts for p in part if p not in known}
        if new:
            self.learn(list(new))
        n_a, n_b, n_groups, lengths = (np.frombuffer(x, np.int64) for x in (self.n_a, self.n_b, self.n_groups, self.lengths))
        self.links, self.times = [np.concatenate(self.links)], [np.concatenate(self.times)]
        links, times, stops = self.links[0], self.times[0], np.cumsum(lengths)
        total = np.append(0, np.cumsum(times))
        n_links = total[stops] - total[stops - lengths]
        if len(self.pairs) > len(self.docs):
            self.docs = np.append(self.docs, np.zeros(2 * len(self.pairs) - len(self.docs), np.int64))
        place = np.empty(max(len(known), len(self.pairs)), np.int64)
        for text, part, digest, times_ in zip(texts, parts, digests, copies):
            ids = np.fromiter(map(known.__getitem__, part), np.int64, len(part))
            self.size += len(text)
            if not n_a[ids].all():
                self.rows.append((digest, 0, 0, 0, 0, "", 0))
                continue
            groups = ";".join(map(self.groups.__getitem__, ids.tolist()))
            self.rows.append((digest, int(n_a[ids].sum()), int(n_b[ids].sum()), int(n_groups[ids].sum()), int(n_links[ids].sum()),
                              hashlib.sha256(groups.encode()).hexdigest(), len(ids)))
            self.stream.append(ids.astype(np.int32))
            # Each different piece of the text once, then each different pair of those.
            once = _distinct(ids, place)
            width = lengths[once]
            at = np.arange(int(width.sum())) + np.repeat(stops[once] - width - (np.cumsum(width) - width), width)
            self.docs[_distinct(links[at], place)] += times_

    def row(self, number: int) -> pa.RecordBatch:
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        columns = list(zip(*self.rows))
        kinds = [pa.binary(), *[pa.int64()] * 4, pa.string(), pa.int32()]
        joined = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind).tobytes()
        times = np.concatenate([np.zeros(0, np.int64), *self.times])
        more = np.flatnonzero(times != 1)  # almost all links are single
        return pa.RecordBatch.from_arrays([
            pa.array([number]), *[one(c, k) for c, k in zip(columns, kinds)],
            *[pa.array([x], pa.binary()) for x in (joined(self.stream, np.int32), joined(self.links, np.int32), more.astype(np.int32).tobytes(),
                                                   times[more].tobytes(), np.frombuffer(self.lengths, np.int64).astype(np.int32).tobytes())],
            one(np.fromiter(self.pairs, np.int64, len(self.pairs)), pa.int64()), one(self.docs[: len(self.pairs)], pa.int64())], names=_NAMES)


def _distinct(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each value once. ``place`` is scratch space: a value's place holds where it was written last."""
    here = np.arange(len(values))
    place[values] = here
    return values[place[values] == here]


_SCHEMA = ("chunk bigint, digest array<binary>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
           "groups array<string>, n_pieces array<int>, stream binary, links binary, more_at binary, more binary, lengths binary, pairs array<bigint>, docs array<bigint>")
_NAMES = [x.split(" ")[0] for x in _SCHEMA.split(", ")]


def digest(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def chunks(docs: DataFrame, path_a: str, path_b: str, text: str = "text", size: int = CHUNK) -> DataFrame:
    """Distinct texts, tokenised and aligned, a row for each chunk."""
    folded = docs.where(F.length(text) > 0).groupBy(F.col(text).alias("text")).agg(F.count("*").alias("copies")).select("text", digest().alias("digest"), "copies")

    def run(batches):
        from pyspark import TaskContext

        part, made, aligner = TaskContext.get().partitionId(), 0, Aligner.of(path_a, path_b)
        chunk = Chunk(aligner)
        for batch in batches:
            texts = batch.column("text")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy())
            start = 0
            while start < batch.num_rows:  # rows of about a megabyte together
                stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + (1 << 20), "right")))
                rows = batch.slice(start, stop - start)
                chunk.add(*(rows.column(c).to_pylist() for c in ("text", "digest", "copies")))
                start = stop
                if chunk.size > size or len(chunk.number) > PIECES:
                    yield chunk.row(part << 32 | made)
                    chunk, made = Chunk(aligner), made + 1
        if chunk.rows:
            yield chunk.row(part << 32 | made)

    return folded.mapInArrow(run, _SCHEMA)


def pair_counts(parts: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold a pair (A id * 2**32 + B id), and whether that is its A id's highest count."""
    counts = stored(parts.select(F.explode(F.arrays_zip("pairs", "docs")).alias("e")).groupBy(F.col("e.pairs").alias("pair")).agg(
        F.sum("e.docs").alias("count")), "pairs").withColumn("a", F.shiftright("pair", 32))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def text_measures(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """digest, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each distinct text that isn't empty."""
    entries = parts.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    told = entries.join(counts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("place", "count", "best")).alias("t"))
    whole = parts.drop("pairs", "docs").join(
        told.select("chunk", F.col("t.place").alias("place"), F.col("t.count").alias("count"), F.col("t.best").alias("best")), "chunk", "left")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = {name: batch.column(name)[k] for name in batch.schema.names}
                stream, links, lengths, more_at = (np.frombuffer(r[c].as_buffer(), np.int32) for c in ("stream", "links", "lengths", "more_at"))
                times, stops = np.ones(len(links), np.int64), np.cumsum(lengths, dtype=np.int64)
                times[more_at] = np.frombuffer(r["more"].as_buffer(), np.int64)
                n = len(r["place"].values) if r["place"].is_valid else 0
                count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
                if n:
                    at = r["place"].values.to_numpy()
                    count[at], best[at] = r["count"].values.to_numpy(), r["best"].values.to_numpy(zero_copy_only=False)
                n_pieces = r["n_pieces"].values.to_numpy()
                text_stops = np.cumsum(n_pieces, dtype=np.int64)
                sums = []
                for value in (best, count):
                    upto = np.append(0, np.cumsum(value[links] * times))
                    of_piece = upto[stops] - upto[stops - lengths]
                    upto = np.append(0, np.cumsum(of_piece[stream]))
                    sums.append(pa.array(upto[text_stops] - upto[text_stops - n_pieces]))
                yield pa.RecordBatch.from_arrays([r[c].values for c in ("digest", "n_a", "n_b", "n_groups", "n_links")] + sums + [r["groups"].values], names=names)

    names = ["digest", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return whole.mapInArrow(run, "digest binary, " + ", ".join(f"{n} bigint" for n in names[1:7]) + ", groups_sha256 string")


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The measures of each row of ``docs``, with its id."""
    parts = stored(chunks(docs, path_a, path_b, text), "alignment")
    found = stored(text_measures(parts, pair_counts(parts)), "measures")
    rows = docs.select(F.col(doc_id).alias(doc_id), digest(text).alias("digest")).join(found, "digest", "left")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return rows.select(doc_id, *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
