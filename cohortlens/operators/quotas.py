"""Sequential quotas from counts.

Buckets are filled one after the other, each from the entities that no earlier bucket took, in the order of a key. What an
entity can fill is a set of buckets, so the whole sequence is decided by how many entities of each set there are up to any
key. These counts are gathered by prefixes of the key: the sequence is solved on them, a prefix that a threshold falls into
taken in proportion, and only such prefixes are looked at more closely, until no threshold falls inside one. The number of
jobs follows the length of the prefixes (the logarithm of the number of entities), not the number of buckets.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Entities whose keys the driver takes at once; with more, a prefix is divided by its next digit.
KEYS = 20_000
#: Sorts after every key, and behind a prefix after every key of that prefix.
LAST = "~"
_SURE = 1e-6


def solve(labels: list[str], masks: np.ndarray, counts: np.ndarray, quota: dict) -> tuple[dict, set]:
    """Thresholds of one cohort, from cells in ascending order of their ``labels`` (a key, or the prefix of several), and the
    labels of prefixes that a threshold falls into. ``masks``: bit b for bucket b; ``quota``: bucket -> size, for all buckets."""
    names = sorted(set(labels))
    place = {n: i for i, n in enumerate(names)}
    cell = np.array([place[x] for x in labels], np.int64)
    left, carry, cuts, inside = counts.astype(np.float64), 0.0, {}, set()
    for bucket in sorted(quota, reverse=True):
        need = quota[bucket] + carry
        mine = ((masks >> bucket) & 1) > 0
        sizes = np.bincount(cell, left * mine, minlength=len(names))
        total = sizes.sum()
        carry = max(need - total, 0.0)
        if need <= 0:
            cuts[bucket] = ""
            continue
        if total <= need + _SURE:
            cuts[bucket] = LAST
            left[mine] = 0
            continue
        upto = np.cumsum(sizes)
        at = int(np.searchsorted(upto, need - _SURE))
        rest = need - (upto[at] - sizes[at])
        left[mine & (cell < at)] = 0
        here = mine & (cell == at)
        if rest >= sizes[at] - _SURE:
            left[here] = 0
            cuts[bucket] = names[at] + LAST
        else:
            left[here] *= 1 - rest / sizes[at]
            inside.add(names[at])
            # Solving in proportion may be off by a little, so the neighbours are looked at as well.
            inside.update(names[k] for k in (at - 1, at + 1) if 0 <= k < len(names))
    return cuts, inside


def thresholds(entities: DataFrame, cohort: str, mask: str, key: str, quotas: dict, most: int = KEYS) -> list[tuple[int, dict]]:
    """(bucket, {cohort: highest key that is taken}) from the highest bucket down; "" takes nothing.

    ``entities``: stored, one row each. ``quotas``: cohort -> {bucket: size}; a bucket that runs out hands its rest on to the next.
    """
    buckets = sorted({b for q in quotas.values() for b in q}, reverse=True)
    if any(not 0 <= b <= 62 for b in buckets):
        raise ValueError("buckets must lie between 0 and 62")
    whole = {c: {b: float(q.get(b, 0)) for b in buckets} for c, q in quotas.items()}
    # cohort -> label -> {mask: count}; a label is a prefix until it is a key.
    cells = {c: {} for c in quotas}
    keys: dict = {c: set() for c in quotas}
    for r in entities.groupBy(cohort, mask).count().collect():
        if r[cohort] in cells:
            cells[r[cohort]].setdefault("", {})[r[mask]] = r["count"]
    todo = {c: {""} if found else set() for c, found in cells.items()}
    while any(todo.values()):
        size = sum(sum(cells[c][p].values()) for c, prefixes in todo.items() for p in prefixes)
        found = _closer(entities, cohort, mask, key, todo, size <= most)
        for c, prefixes in todo.items():
            for p in prefixes:
                del cells[c][p]
        for c, label, m, n in found:
            cells[c].setdefault(label, {})[m] = n
            if size <= most:
                keys[c].add(label)
        todo, cuts = {}, {}
        for c, mine in cells.items():
            rows = [(label, m, n) for label, masks in mine.items() for m, n in masks.items()]
            rows.sort(key=lambda r: r[0])
            cuts[c], inside = solve([r[0] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.float64), whole[c])
            open_ = {p for p in inside if p not in keys[c]}
            # A threshold inside a key only comes from a prefix elsewhere that isn't settled.
            todo[c] = open_
    if not any(cells.values()):
        return [(b, {c: LAST if whole[c][b] > 0 else "" for c in quotas}) for b in buckets]
    cuts = {c: cuts.get(c) or dict.fromkeys(buckets, "") for c in quotas}
    return [(b, {c: cuts[c].get(b, "") for c in quotas}) for b in buckets]


def _closer(entities, cohort, mask, key, todo, single) -> list[tuple]:
    """(cohort, label, mask, count) of the entities under the given prefixes, by key or by the prefix with one digit more."""
    matches, labels = [], []
    for c, prefixes in todo.items():
        for length in sorted({len(p) for p in prefixes}):
            mine = sorted(p for p in prefixes if len(p) == length)
            match = (F.col(cohort) == c) & F.substring(key, 1, length).isin(mine) if length else F.col(cohort) == c
            matches.append(match)
            labels.append(F.when(match, F.col(key) if single else F.substring(key, 1, length + 1)))
    any_ = matches[0]
    for m in matches[1:]:
        any_ = any_ | m
    rows = entities.where(any_).select(cohort, F.coalesce(*labels).alias("label"), mask).groupBy(cohort, "label", mask).count()
    return [tuple(r) for r in rows.collect()]


def assigned(cuts: list[tuple[int, dict]], cohort: str, mask: str, key: str) -> Column:
    """The bucket of an entity, or NULL."""
    hits = []
    for bucket, limits in cuts:
        limit = F.coalesce(*[F.when(F.col(cohort) == c, F.lit(k)) for c, k in limits.items()])
        mine = F.col(mask).bitwiseAND(F.lit(1 << bucket).cast("long")) != 0
        hits.append(F.when(mine & (F.col(key) <= limit), bucket))
    return F.coalesce(*hits, F.lit(None).cast("int"))
