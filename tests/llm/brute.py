"""Plain versions of the operators, a document at a time, for tests."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return [w.decode() for w in WORD.findall((text or "").encode())]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def remainder(doc_id, m):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % m


def base_rules(text):
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times, hit = Counter(windows), set()
    for i, x in enumerate(windows):
        if times[x] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def token_rows(rows, tokenizer, end=1):
    """doc_id, start, n_tokens, crc of rows in order."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fingerprints, radius=2):
    """Smallest id reachable, all pairs compared."""
    values = np.array(sorted(set(fingerprints)), np.uint64)
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius) + i + 1:
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    place, least = {int(v): k for k, v in enumerate(values)}, {}
    for d, f in zip(ids, fingerprints):
        r = root(place[f])
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(root(place[f])) for f in fingerprints]


def luhn(digits):
    doubled = [int(d) for d in digits[::-1]]
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(doubled)) % 10 == 0


def base_pii(text):
    text = text or ""
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    spans = [(k, s, e) for s, _, k, e in sorted(out)]
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    count = Counter(k for k, _, _ in spans)
    return count["email"], count["ip"], count["card"], count["phone"], hashlib.sha256(joined.encode()).hexdigest(), joined


def mix_targets(sizes, most=3):
    """{source: words} to {source: target} by repeated resharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, free, out = sum(sizes.values()), set(order), {}
    left = total
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= over
    return out


def exact_groups(rows):
    """(doc_id, keep_id, group_size, kept, sha) for rows of distinct ids."""
    by = defaultdict(list)
    shas = []
    for doc_id, text in rows:
        shas.append(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest())
        by[shas[-1]].append(doc_id)
    return [(d, min(by[s]), len(by[s]), d == min(by[s]), s) for (d, _), s in zip(rows, shas)]


def base_scores(rows):
    """doc_id: held_out, n_tokens, n_known, N, base."""
    counts = Counter()
    for doc_id, text in rows:
        if remainder(doc_id, 7) != 2:
            counts.update([*words(lower(text)), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc_id, text in rows:
        t = [*words(lower(text)), None]
        out.append((doc_id, remainder(doc_id, 7) == 2, len(t), sum(counts[x] > 0 for x in t), n,
                    sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)))
    return out


def alignment(rows, tokenizer, model):
    """doc_id -> n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; ``tokenizer`` treats special tokens as text."""
    from cohortlens.llm.op09_bpe import byte_letters

    letters, docs, counts = byte_letters(), [], Counter()
    for doc_id, text in rows:
        links, groups = [], []
        if text:
            whole = (" " + text).encode()
            a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            raw_a = [bytes(letters[c] for c in tokenizer.id_to_token(i)) for i in a]
            pieces = [model.id_to_piece(i) for i in b]
            raw_b = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
            if b"".join(raw_a) == whole == b"".join(raw_b):
                end_a, end_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
                borders, i, j = sorted(set(end_a) & set(end_b)), 0, 0
                for border in borders:
                    x, y = end_a.index(border, i) + 1, end_b.index(border, j) + 1
                    groups.append((a[i:x], b[j:y]))
                    i, j = x, y
                links = [(p, q) for x, y in groups for p in x for q in y]
        docs.append((doc_id, groups, links))
        counts.update(set(links))
    best = defaultdict(int)
    for (p, _), c in counts.items():
        best[p] = max(best[p], c)
    out = {}
    for doc_id, groups, links in docs:
        line = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out[doc_id] = (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                       sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links),
                       hashlib.sha256(line.encode()).hexdigest() if groups else "")
    return out


def phrases(rows, least=10, top=2000):
    """Collocations of (text, lang) rows, as rows of lang, rank, phrase, a, l, r, n, score."""
    counts, sizes, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = [x for x in re.split("[ \t]", piece) if x]
            sizes["und" if lang is None else lang] += len(w)
            for n in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(100 * c >= 50 * a for q, c in f.items() if len(q) == 3 and c >= least and p in (q[:2], q[1:])):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)
