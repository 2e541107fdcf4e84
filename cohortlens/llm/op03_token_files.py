"""Token ids in binary files of patched frame-of-reference blocks.

Documents are dealt by ranges of their id and encoded in order. A row of the files is a segment: consecutive whole documents
with about ``SEGMENT`` ids (a longer document is a segment of its own), so a reader opens any segment alone and a lost task
repeats only its own. In a segment the ids form one stream, cut into blocks of ``BLOCK`` values:

- ``bases``: each block's minimum, 32 bits;
- ``widths``: bits for each packed difference, 8 bits; the least width that holds ``SHARE`` of the block's differences;
- ``packed``: the blocks' differences, their low ``width`` bits, in 64-bit words;
- ``starts``: where each block begins in ``packed`` (64-bit words, 32 bits), the block index;
- ``n_exceptions``, ``exception_at``, ``exception_value``: for each block the positions and full differences that need more.

The files are Parquet written by Spark's own committer in the shared folder; all numbers are little-endian.

Defined cases: a missing text is empty and holds the end id alone; rows without an id come first; rows with equal ids follow
each other in order of their text; an empty table gives files without segments.
"""

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.llm.common import trimmed

BLOCK, SEGMENT, SHARE = 128, 1 << 18, 0.9
MEMO = 500_000
#: Texts that are encoded together.
ROWS = 1024

#: What a piece may not hold to be split here, and the tokenizer's split pattern over lower-case Latin-1 (fixed values: letters
#: and numbers among its characters), or the end of a piece.
_OTHER = re.compile("[^\x21-\x7e\xa1-\xff\n]")
_SPLIT = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^\na-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+|\n")

FILE_SCHEMA = (
    "shard int, segment int, n_ids bigint, doc_ids array<bigint>, n_tokens array<bigint>, bases binary, widths binary, "
    "starts binary, packed binary, n_exceptions binary, exception_at binary, exception_value binary")


class WordEncoder:
    """Encodes with a tokenizer of the tokenizers library that drops white space and treats what stands between as on its
    own. Ids of a piece between spaces are looked up where it was met before.

    New pieces of Latin-1 characters need no normalisation but lower case. They are split together by the tokenizer's
    pattern, and the library encodes all new words of a batch in one text, where each word ends with one token that bears
    the word-end suffix. Other pieces go to the library as they are. Both memos are bounded."""

    _known: dict = {}
    #: After the end of a piece; no token has this id, and no run of ids contains its bytes.
    _STOP = b"\xff\xff\xff\xff"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, vocab = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 3, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.added = [t["content"] for t in spec["added_tokens"]]
        # For words that are split and in lower case already.
        bytes_only = spec["pre_tokenizer"]["pretokenizers"][1]
        self.plain = Tokenizer.from_str(json.dumps(spec | {
            "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytes_only]}}))
        for t in (self.tokenizer, self.plain):
            t.no_truncation()
            t.no_padding()
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        out = []
        for start in range(0, len(words), 5000):
            part = words[start : start + 5000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(stops) != len(part) or stops[-1] != 4 * len(ids):
                out += self._library(part)
                continue
            code, stops = ids.tobytes(), stops.tolist()
            out += [code[i:j] for i, j in zip([0, *stops], stops)]
        return out

    def _learn(self, new: list[str]) -> None:
        whole = "\n".join(new)
        if _OTHER.search(whole) or any(t in whole for t in self.added):
            simple = [p for p in new if not _OTHER.search(p) and not any(t in p for t in self.added)]
            rest = list(set(new).difference(simple))
            self.pieces.update(zip(rest, self._library(rest)))
            new, whole = simple, "\n".join(simple)
        if not new:
            return
        self.words = words = trimmed(self.words, MEMO)
        cut = _SPLIT.findall(whole.lower() + "\n")
        unknown = [w for w in set(cut) if w not in words and w != "\n"]
        words.update(zip(unknown, self._words(unknown)))
        words["\n"] = self._STOP
        self.pieces.update(zip(new, b"".join([words[w] for w in cut]).split(self._STOP)))

    def encode(self, texts) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers. ``texts``: an Arrow array of strings, or a list. Each distinct
        piece of them is looked up once; Arrow splits the texts and puts the pieces' ids together."""
        self.pieces = pieces = trimmed(self.pieces, MEMO)
        whole = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        split = pc.split_pattern(pc.replace_substring(whole.fill_null(""), "\n", " "), " ")
        places = split.flatten().dictionary_encode()
        distinct = places.dictionary.to_pylist()
        new = [p for p in distinct if p not in pieces]
        if new:
            self._learn(new)
        codes = pa.array([pieces[p] for p in distinct], pa.large_binary()).take(places.indices)
        _, offsets, data = codes.buffers()
        ends = np.frombuffer(offsets, np.int64)[split.offsets.to_numpy()].tolist() if len(codes) else [0]
        stream = memoryview(data or b"")
        return [bytes(stream[i:j]) for i, j in zip(ends, ends[1:])]


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) of uint64 below 2**width to (blocks, words)."""
    n, words = len(values), (BLOCK * width + 63) // 64
    out, columns = np.zeros((words, n), "<u8"), np.ascontiguousarray(values.T)
    for j in range(BLOCK if width else 0):
        word, shift = divmod(j * width, 64)
        out[word] |= columns[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``pack``."""
    out, columns = np.zeros((BLOCK, len(words)), "<u8"), np.ascontiguousarray(words.T)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK if width else 0):
        word, shift = divmod(j * width, 64)
        out[j] = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            out[j] |= columns[word + 1] << np.uint64(64 - shift)
    return np.ascontiguousarray((out & mask).T)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each non-negative value below 2**32 needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def encode_blocks(ids: np.ndarray) -> dict[str, bytes]:
    """One stream of ids to the binary fields of a segment."""
    blocks = -(-len(ids) // BLOCK)
    grid = np.full(blocks * BLOCK, ids[-1] if len(ids) else 0, np.uint64)
    grid[: len(ids)] = ids
    grid = grid.reshape(blocks, BLOCK)
    bases = grid.min(axis=1) if blocks else np.zeros(0, np.uint64)
    rest = grid - bases[:, None]
    rank = int(np.ceil(SHARE * BLOCK)) - 1
    widths = bit_lengths(np.partition(rest, rank, axis=1)[:, rank]) if blocks else np.zeros(0, np.uint8)
    over = rest >> widths[:, None].astype(np.uint64) > 0
    low = rest & ((np.uint64(1) << widths[:, None].astype(np.uint64)) - np.uint64(1))
    sizes = (BLOCK * widths.astype(np.int64) + 63) // 64
    ends = np.cumsum(sizes)
    starts, packed = ends - sizes, np.zeros(int(ends[-1]) if blocks else 0, "<u8")
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        words = pack(low[at], int(width))
        packed[(starts[at][:, None] + np.arange(words.shape[1])).ravel()] = words.ravel()
    return {
        "bases": bases.astype("<u4").tobytes(), "widths": widths.tobytes(), "starts": starts.astype("<u4").tobytes(),
        "packed": packed.tobytes(), "n_exceptions": over.sum(axis=1).astype(np.uint8).tobytes(),
        "exception_at": np.nonzero(over)[1].astype(np.uint8).tobytes(), "exception_value": rest[over].astype("<u4").tobytes()}


def decode_blocks(fields: dict[str, bytes], first: int, last: int) -> np.ndarray:
    """Blocks ``first`` up to ``last`` (not included) of a segment, found by the block index, as 32-bit ids."""
    bases = np.frombuffer(fields["bases"], "<u4")[first:last].astype(np.uint64)
    widths = np.frombuffer(fields["widths"], np.uint8)[first:last]
    starts = np.frombuffer(fields["starts"], "<u4")[first:last].astype(np.int64)
    packed = np.frombuffer(fields["packed"], "<u8")
    counts = np.frombuffer(fields["n_exceptions"], np.uint8).astype(np.int64)
    skip, stop = int(counts[:first].sum()), int(counts[:last].sum())
    out = np.zeros((len(bases), BLOCK), np.uint64)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        words = (BLOCK * int(width) + 63) // 64
        out[at] = unpack(packed[starts[at][:, None] + np.arange(words)], int(width))
    row = np.repeat(np.arange(len(bases)), counts[first:last])
    out[row, np.frombuffer(fields["exception_at"], np.uint8)[skip:stop]] = np.frombuffer(fields["exception_value"], "<u4")[skip:stop]
    return (out + bases[:, None]).astype("<u4").ravel()


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode ``text`` of every row, append ``end_id`` and write segments to ``path`` in order of ``doc_id`` (an integer)."""
    schema = pa.schema([
        ("shard", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())), *[(n, pa.binary()) for n in (
            "bases", "widths", "starts", "packed", "n_exceptions", "exception_at", "exception_value")]])

    def run(batches):
        from pyspark import TaskContext

        shard, encoder, end = TaskContext.get().partitionId(), WordEncoder.of(tokenizer), np.array([end_id], "<u4").tobytes()
        ids, docs_of, lengths, size, segment = [], [], [], 0, 0

        def row():
            stream = np.frombuffer(b"".join(ids), "<u4")
            values = {"shard": shard, "segment": segment, "n_ids": len(stream), "doc_ids": docs_of, "n_tokens": lengths, **encode_blocks(stream)}
            return pa.RecordBatch.from_arrays([pa.array([values[f.name]], f.type) for f in schema], schema=schema)

        for whole in batches:
            for batch in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                found = batch.column("doc_id").to_pylist()
                for d, code in zip(found, encoder.encode(batch.column("text"))):
                    code += end
                    if size and size + len(code) // 4 > SEGMENT:
                        yield row()
                        ids, docs_of, lengths, size, segment = [], [], [], 0, segment + 1
                    ids.append(code)
                    docs_of.append(d)
                    lengths.append(len(code) // 4)
                    size += len(code) // 4
        if size:
            yield row()

    # Dealt by the texts' rows and not by their ids, so that the ranges are found without encoding anything.
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(
        "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """A row for each document of the files: doc_id, n_tokens, ids (binary, little-endian 32-bit) and where it stands:
    ``shard``, ``segment`` and ``inner``, the ids before it in the segment."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                stream = decode_blocks(r, 0, len(r["widths"]))
                ends = np.cumsum(r["n_tokens"])
                codes = [stream[e - n : e].tobytes() for e, n in zip(ends.tolist(), r["n_tokens"])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["shard"]] * len(codes), pa.int32()), pa.array([r["segment"]] * len(codes), pa.int32()),
                    pa.array(r["doc_ids"], pa.int64()), pa.array(ends - np.array(r["n_tokens"]), pa.int64()),
                    pa.array(r["n_tokens"], pa.int64()), pa.array(codes, pa.binary())],
                    names=["shard", "segment", "doc_id", "inner", "n_tokens", "ids"])

    return spark.read.schema(FILE_SCHEMA).parquet(path).mapInArrow(
        run, "shard int, segment int, doc_id bigint, inner bigint, n_tokens bigint, ids binary")


def with_starts(found: DataFrame, path: str) -> DataFrame:
    """Adds ``start``, the ids of all documents before, to rows of ``read_documents``. A shard's segments are summed in its
    own task, and only the shards' totals, one for each file, meet in a window. Drop ``ids`` first if they aren't needed."""
    sizes = found.sparkSession.read.schema(FILE_SCHEMA).parquet(path).select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before_shard"))
    inside = Window.partitionBy("shard").orderBy("segment")
    before = sizes.select("shard", "segment", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("before")).join(shards, "shard")
    return found.join(before, ["shard", "segment"]).withColumn(
        "start", F.col("before_shard") + F.col("before") + F.col("inner")).drop(
        "shard", "segment", "inner", "before", "before_shard")


def read_range(segment: dict, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` up to ``stop`` of one segment, from the blocks that hold them."""
    first, last = start // BLOCK, -(-stop // BLOCK)
    return decode_blocks(segment, first, last)[start - first * BLOCK : stop - first * BLOCK]
