"""Byte-level BPE encoding by speculation and verification, and decoding.

Words (what the vocabulary's split pattern gives) that a task has not met are encoded together, as rows of byte matrices.
Speculation: each word is cut greedily into the longest tokens of the vocabulary, found by walking the tokens' prefix tree from
all places of all words at once. Verification: a cut is what the merges give exactly if every two adjacent
tokens would stay apart when merged alone; that is tested for all adjacent pairs of all new words at once, in numpy, by
undoing the two tokens' merges along their touching sides in order of rank and looking for a merge across the border that
would have come earlier. Only words with a failing pair go through the exact merging, which makes one merge in each of them at
a time. Words of more than ``WIDE`` bytes are cut and merged one by one.

Texts are cut before single spaces between other characters, where the pattern always ends a word; ids of such a piece are
remembered, as those of the words in it are; the memo is bounded. Added tokens of the file (as the end of a text) are taken out of a
text first, as the tokenizers library does. Every text is encoded whole, in its own task; nothing is shuffled.

The method needs a vocabulary whose tokens are all made by its merges, in order of their ids; that is checked on loading.

Defined cases: a missing text is empty and has no ids; repeated rows give a row each; ids that the vocabulary lacks cannot be
decoded and raise an error; decoded bytes that are no UTF-8 become replacement characters.
"""

import json
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from cohortlens.llm.common import append, texts_of, trimmed

#: Pieces and words whose ids a task remembers; about 50 MB.
MEMO = 240_000

SHORT = 64
#: Widths of the byte matrices; longer words are no rows.
WIDTHS = (8, 16, 32)
WIDE = WIDTHS[-1]
_NO_MERGE = np.int32(np.iinfo(np.int32).max)
_NONE = (1 << 60, -1)

#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN)
#: White space before a space: there the pattern may look across the cut.
_RUN = regex.compile(r"\s\x20")


def byte_letters() -> dict[str, int]:
    """The letter that a vocabulary file writes for each byte: itself if it is printable Latin-1, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Added(str):
    """An added token found in a text; it equals no piece."""

    __hash__ = object.__hash__

    def __eq__(self, other):
        return self is other


class ByteBpe:
    """A vocabulary read from a tokenizers file."""

    _known: dict = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab = vocab
        # The longest token that begins with some three bytes, or with fewer at the end of a word.
        self.longest: dict[bytes, int] = {}
        for b in vocab:
            for head in {b[:1], b[:2], b[:3]}:
                self.longest[head] = max(self.longest.get(head, 0), len(b))
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.token_bytes: list[bytes | None] = [None] * size
        for b, i in vocab.items():
            self.token_bytes[i] = b
        for t, i in self.added.items():
            self.token_bytes[i] = t.encode()
        # Rank of each token: 0 for a byte, else the place of its merge from 1 on; left and right parts; the merges as keys.
        self.rank, self.left, self.right = np.zeros(size, np.int64), np.full(size, -1), np.full(size, -1)
        self.single = [vocab[bytes([b])] for b in range(256)]
        merges, self.ranks, self.made = [], {}, [-1]
        for k, pair in enumerate(spec["model"]["merges"], 1):
            a, b = (vocab[raw(x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            made = vocab[self.token_bytes[a] + self.token_bytes[b]]
            if self.rank[made]:
                raise ValueError("a token is made by two merges")
            self.rank[made], self.left[made], self.right[made] = k, a, b
            self.ranks[a, b] = (k, made)
            self.made.append(made)
            merges.append((a << 32 | b, k))
        if any(len(b) > 1 and not self.rank[i] for b, i in vocab.items()):
            raise ValueError("a token is made by no merge")
        merges.sort()
        self.merge_keys = np.array([m[0] for m in merges], np.int64)
        self.merge_ranks = np.array([m[1] for m in merges], np.int64)
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.made_ids = np.array(self.made, np.int32)
        self.byte_ids = np.array(self.single, np.int32)
        pairs = np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)
        self.byte_ranks = self._ranks(*pairs).reshape(256, 256)
        self._plant(vocab)
        known = [b"" if b is None else b for b in self.token_bytes]
        self.sizes = np.array([len(b) for b in known], np.int64)
        self.starts, self.blob = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(known), np.uint8)
        self.known: dict[str, bytes] = {}
        self.exact_words = 0

    def _plant(self, vocab: dict[bytes, int]) -> None:
        """The prefix tree: a hash table from (node, byte) to node, and each node's token."""
        nodes, tokens, edges = {b"": 0}, [-1], {}
        for b, i in vocab.items():
            at = 0
            for k in range(1, len(b) + 1):
                node = nodes.get(b[:k])
                if node is None:
                    node = nodes[b[:k]] = len(tokens)
                    tokens.append(-1)
                    edges[at << 8 | b[k - 1]] = node
                at = node
            tokens[at] = i
        self.node_token = np.array(tokens, np.int32)
        self.bits = max(4, (3 * len(edges)).bit_length())
        self.edge_keys, self.edge_nodes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        keys, values = np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32)
        slots = self._slots(keys)
        while len(keys):
            _, first = np.unique(slots, return_index=True)
            first = first[self.edge_keys[slots[first]] < 0]
            self.edge_keys[slots[first]], self.edge_nodes[slots[first]] = keys[first], values[first]
            left = self.edge_keys[slots] != keys
            keys, values, slots = keys[left], values[left], (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """The nodes of (node, byte) keys, -1 where there is none."""
        out, slots, open_ = np.full(len(keys), -1, np.int32), self._slots(keys), np.arange(len(keys))
        while len(open_):
            here = self.edge_keys[slots]
            hit = here == keys[open_]
            out[open_[hit]] = self.edge_nodes[slots[hit]]
            on = ~hit & (here >= 0)
            open_, slots = open_[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        rank = self.merge_of(a.astype(np.int64), b.astype(np.int64))
        return np.where(rank > 0, rank, _NO_MERGE).astype(np.int32)

    @classmethod
    def of(cls, path: str) -> "ByteBpe":
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def speculate(self, word: bytes) -> list[int]:
        """The longest token at each place, from the left."""
        whole = self.vocab.get(word)
        if whole is not None:
            return [whole]
        out, at, n, vocab, longest = [], 0, len(word), self.vocab, self.longest
        while at < n:
            head = word[at : at + 3]
            most = longest.get(head) or longest.get(head[:2]) or 1
            for end in range(min(n, at + most), at, -1):
                token = vocab.get(word[at:end])
                if token is not None:
                    out.append(token)
                    at = end
                    break
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens ``a`` and ``b``, put together, encode as just these two.

        Both are undone, the later merge first (of equal ranks the right one, which the merging from the left made last),
        down to the bytes that touch. A merge across the border that exists at some moment breaks the pair if its turn came
        before that of the merge which then was already undone."""
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        limit, own = np.full(len(a), np.iinfo(np.int64).max), np.zeros(len(a), bool)
        while len(live):
            x, y = a[live], b[live]
            rank = self.merge_of(x, y)
            # Equal rank: merges of one rank go from the left, so the border's came first if the undone one lies to its right.
            broken = (rank > 0) & ((rank < limit[live]) | (rank == limit[live]) & own[live])
            ok[live[broken]] = False
            rx, ry = self.rank[x], self.rank[y]
            live, x, y, rx, ry = (z[~broken & ((rx > 0) | (ry > 0))] for z in (live, x, y, rx, ry))
            undo_right = ry >= rx
            limit[live], own[live] = np.where(undo_right, ry, rx), undo_right
            a[live] = np.where(undo_right, x, self.right[x])
            b[live] = np.where(undo_right, self.left[y], y)
        return ok

    def merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; 0 if there is none."""
        if not len(self.merge_keys):
            return np.zeros(len(a), np.int64)
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == keys, self.merge_ranks[at], 0)

    def merge(self, word: bytes) -> list[int]:
        """The exact way: the earliest merge of all adjacent pairs, leftmost first, until none is left. The pairs of a short
        word stand in a list, those of a long one wait in a heap, so that it takes n log n steps."""
        tokens = [self.single[b] for b in word]
        if len(tokens) > SHORT:
            return self._merge_long(tokens)
        get = self.ranks.get
        waiting = [get(p, _NONE)[0] for p in zip(tokens, tokens[1:])]
        while waiting:
            least = min(waiting)
            if least == _NONE[0]:
                break
            i = waiting.index(least)
            tokens[i : i + 2] = [self.made[least]]
            del waiting[i]
            if i:
                waiting[i - 1] = get((tokens[i - 1], tokens[i]), _NONE)[0]
            if i < len(waiting):
                waiting[i] = get((tokens[i], tokens[i + 1]), _NONE)[0]
        return tokens

    def _merge_long(self, tokens: list[int]) -> list[int]:
        n = len(tokens)
        after, before, ranks = list(range(1, n + 1)), list(range(-1, n - 1)), self.ranks
        heap = [(ranks[p][0], i, *p) for i, p in enumerate(zip(tokens, tokens[1:])) if p in ranks]
        heapify(heap)
        while heap:
            _, i, x, y = heappop(heap)
            j = after[i]
            if tokens[i] != x or j >= n or tokens[j] != y:
                continue
            tokens[i], tokens[j], after[i] = ranks[x, y][1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                p = (tokens[i], tokens[after[i]])
                if p in ranks:
                    heappush(heap, (ranks[p][0], i, *p))
            if before[i] >= 0:
                p = (tokens[before[i]], tokens[i])
                if p in ranks:
                    heappush(heap, (ranks[p][0], before[i], *p))
        return [t for t in tokens if t >= 0]

    def propose_rows(self, data: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The greedy cuts of words in the rows of a byte matrix: tokens by row, -1 behind the last."""
        n, wide = data.shape
        flat = data.ravel()
        here = np.flatnonzero(np.arange(wide) < length[:, None])
        room = (length[:, None] - np.arange(wide)).ravel()
        token_at, size_at, node, d = np.zeros(n * wide, np.int32), np.zeros(n * wide, np.int64), np.zeros(len(here), np.int64), 0
        while len(here):  # the longest token from each place
            node = self._step(node << 8 | flat[here + d]).astype(np.int64)
            on = node >= 0
            here, node = here[on], node[on]
            token = self.node_token[node]
            whole = token >= 0
            token_at[here[whole]] = token[whole]
            d += 1
            size_at[here[whole]] = d
            on = room[here] > d
            here, node = here[on], node[on]
        out, place, rows, k = np.full((n, wide), -1, np.int32), np.zeros(n, np.int64), np.arange(n), 0
        while len(rows):
            at = rows * wide + place[rows]
            out[rows, k] = token_at[at]
            place[rows] += size_at[at]
            rows = rows[place[rows] < length[rows]]
            k += 1
        return out

    def merge_rows(self, data: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The exact merging of words in the rows of a byte matrix: the earliest merge of each row, leftmost first, until none is
        left in any."""
        n, wide = data.shape
        columns = np.arange(wide)
        tokens = np.where(columns < length[:, None], self.byte_ids[data], -1).astype(np.int32)
        ranks = np.where(columns[1:] < length[:, None], self.byte_ranks[data[:, :-1], data[:, 1:]], _NO_MERGE)
        out, rows = np.empty((n, wide), np.int32), np.arange(n)
        while len(rows):
            i = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), i]
            on = least < _NO_MERGE
            out[rows[~on]] = tokens[~on]
            rows, tokens, ranks, i, least = rows[on], tokens[on], ranks[on], i[on], least[on]
            each = np.arange(len(rows))
            behind = columns > i[:, None]
            tokens = np.where(behind, np.pad(tokens[:, 1:], ((0, 0), (0, 1)), constant_values=-1), tokens)
            ranks = np.where(behind[:, :-1], np.pad(ranks[:, 1:], ((0, 0), (0, 1)), constant_values=_NO_MERGE), ranks)
            tokens[each, i] = self.made_ids[least]
            # Only the pairs on both sides of the new token are new.
            right = np.where(i + 1 < wide, tokens[each, np.minimum(i + 1, wide - 1)], -1)
            at = np.minimum(i, wide - 2)
            ranks[each, at] = np.where((i < wide - 1) & (right >= 0), self._ranks(tokens[each, i], np.maximum(right, 0)), _NO_MERGE)
            left = np.flatnonzero(i > 0)
            ranks[left, i[left] - 1] = self._ranks(tokens[left, i[left] - 1], tokens[left, i[left]])
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, one after the other, and how many each has: speculate, verify all pairs, merge exactly where a
        pair fails."""
        sizes = np.array([len(w) for w in words], np.int64)
        counts, found = np.zeros(len(words), np.int64), []
        for low, wide in zip((0, *WIDTHS), WIDTHS):
            mine = np.flatnonzero((sizes > low) & (sizes <= wide))
            if not len(mine):
                continue
            data = np.frombuffer(b"".join([words[k].ljust(wide, b"\0") for k in mine.tolist()]), np.uint8).reshape(len(mine), wide)
            tokens = self.propose_rows(data, sizes[mine])
            row, k = np.nonzero(tokens[:, 1:] >= 0)
            failing = np.unique(row[~self.apart(tokens[row, k], tokens[row, k + 1])])
            if len(failing):
                tokens[failing] = self.merge_rows(data[failing], sizes[mine[failing]])
            self.exact_words += len(failing)
            counts[mine] = (tokens >= 0).sum(axis=1)
            found.append((mine, tokens[tokens >= 0]))
        for k in np.flatnonzero(sizes > WIDE).tolist():
            ids = np.array(self.speculate(words[k]), np.int64)
            if not self.apart(ids[:-1], ids[1:]).all():
                ids = np.array(self.merge(words[k]), np.int64)
                self.exact_words += 1
            counts[k] = len(ids)
            found.append((np.array([k]), ids))
        out, starts = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for mine, ids in found:
            n = counts[mine]
            out[np.arange(len(ids)) + np.repeat(starts[mine] - (np.cumsum(n) - n), n)] = ids
        return out, counts

    def _learn(self, pieces: list[str]) -> None:
        known = self.known
        # A space and letters are one word; the pattern cuts the others.
        cut = [(p,) if p[1:].isalpha() and p[0] == " " else _SPLIT.findall(p) for p in pieces]
        new = list({w for words in cut for w in words if w not in known})
        found, counts = self.encode_words([w.encode() for w in new])
        flat, ends = found.astype("<i4").tobytes(), (4 * np.cumsum([0, *counts.tolist()])).tolist()
        known.update(zip(new, [flat[i:j] for i, j in zip(ends, ends[1:])]))
        known.update([(p, b"".join([known[w] for w in c])) for p, c in zip(pieces, cut) if len(c) > 1])

    @staticmethod
    def cut(text: str) -> list[str]:
        """Pieces of a text that the pattern treats on their own."""
        if _RUN.search(text):
            # Cut only where the character before the space is none of the white space.
            return [x for x in regex.split(r"(?<=\S)(?=\x20)", text, flags=regex.V1) if x]
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        self.known = known = trimmed(self.known, MEMO)
        parts = [self._parts(x) for x in texts]
        met = set()
        for part in parts:
            met.update(part)
        new = [p for p in met if p not in known]
        added = [p for p in new if isinstance(p, Added)]
        if len(new) > len(added):
            self._learn([p for p in new if not isinstance(p, Added)] if added else new)
        known.update((p, np.array([self.added[str(p)]], "<i4").tobytes()) for p in added)
        found = [b"".join(map(known.__getitem__, part)) for part in parts]
        for p in added:
            del known[p]
        return found

    def _parts(self, text: str) -> list:
        if self.special is None or not self.special.search(text):
            return self.cut(text)
        out, past = [], 0
        for m in self.special.finditer(text):
            out += [*self.cut(text[past : m.start()]), Added(m.group())]
            past = m.end()
        return out + self.cut(text[past:])

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The texts of ids that stand one after the other, ``lengths`` of them each."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        data = self.blob[np.arange(int(sizes.sum())) + np.repeat(self.starts[ids] - (ends - sizes), sizes)].tobytes()
        stops = np.append(0, ends)[np.append(0, np.cumsum(lengths))].tolist()
        return [data[i:j].decode("utf-8", "replace") for i, j in zip(stops, stops[1:])]


def _arrays(codes: list[bytes]) -> pa.ListArray:
    offsets = pa.array(np.cumsum([0, *map(len, codes)]) // 4, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(codes), "<i4")))


def _mapped(rows: DataFrame, path: str, make, **columns) -> DataFrame:
    """``rows`` with the columns that ``make(bpe, batch)`` gives for a batch of a few hundred rows."""
    rows = rows.drop(*columns)

    def run(batches):
        bpe = ByteBpe.of(path)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                yield append(batch, dict(zip(columns, make(bpe, batch))))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in columns.items())]))


def _decoded(bpe: ByteBpe, column: pa.ListArray) -> pa.Array:
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return pa.array(bpe.decode(column.flatten().to_numpy(zero_copy_only=False), lengths), pa.string())


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, an array of token ids; an equally named column of the input is replaced."""
    return _mapped(docs, path, lambda bpe, batch: [_arrays(bpe.encode(texts_of(batch, text)))], ids=T.ArrayType(T.IntegerType()))


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text of an array of ids; a missing array is empty; an equally named column is
    replaced."""
    return _mapped(tokens, path, lambda bpe, batch: [_decoded(bpe, batch.column(batch.schema.get_field_index(ids)))], decoded=T.StringType())


def encode_and_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and with ``decoded``, the text that these ids give, in one pass over the rows."""
    def both(bpe, batch):
        ids = _arrays(bpe.encode(texts_of(batch, text)))
        return [ids, _decoded(bpe, ids)]

    return _mapped(docs, path, both, ids=T.ArrayType(T.IntegerType()), decoded=T.StringType())


def digests(tokens: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Replaces ids and text by n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256."""
    return tokens.withColumn("n_tokens", F.size(ids).cast("long")).withColumn(
        "ids_sha256", F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)).withColumn(
        "decoded_sha256", F.sha2(decoded, 256)).drop(ids, decoded)
