"""Search for the first crossing of two success rates that move against each other through ranked groups.

Rows stay where they are: a group's rates by rank are one stored table, of which only the lowest and highest rate of each range
of ranks reach the driver. A step count whose target rate can't reach the reference rate within its ranges is dropped with the
whole range; exact rates are looked up only in the ranges that are left, first ones first.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Ranges of ranks that a group is cut into at most, and ranges that one look-up takes for each cut.
RANGES, AHEAD = 4096, 4


def _rate():
    return F.col("cum_y") / F.col("k")


def range_bounds(ranked: DataFrame, groups, ranges: int = RANGES) -> tuple[int, dict]:
    """(ranks a range, group -> (ranks, lowest, highest rate by range)). ``ranked``: stored grp, k (rank from 1), cum_y."""
    sizes = {r["grp"]: r["n"] for r in ranked.groupBy("grp").agg(F.max("k").alias("n")).collect()}
    step = max(1, -(-max(sizes.values(), default=1) // ranges))
    part = F.floor((F.col("k") - 1) / step).cast("int").alias("part")
    rows = ranked.groupBy("grp", part).agg(F.min(_rate()).alias("low"), F.max(_rate()).alias("high")).collect()
    out = {}
    for g in groups:
        mine = sorted((r["part"], r["low"], r["high"]) for r in rows if r["grp"] == g)
        out[g] = (sizes.get(g, 0), np.array([x[1] for x in mine]), np.array([x[2] for x in mine]))
    return step, out


def candidate_ranges(n1: int, n2: int, step: int, target: tuple, reference: tuple, least: int = 2) -> list[tuple[int, int]]:
    """Ranges (first, last) of j in ascending order in which the target rate at rank n1 + j may reach the reference rate at
    rank n2 - j."""
    size1, _, high = target
    size2, low, _ = reference
    last = min(size1 - n1, n2 - 1)
    first = max(least, n2 - size2)
    if last < first:
        return []
    parts = np.arange((n1 + first - 1) // step, (n1 + last - 1) // step + 1)
    start = np.maximum(parts * step + 1 - n1, first)
    stop = np.minimum((parts + 1) * step - n1, last)
    # The reference ranks n2 - stop ... n2 - start lie in at most two ranges.
    lowest = np.minimum(low[(n2 - stop - 1) // step], low[(n2 - start - 1) // step])
    kept = high[parts] >= lowest
    return list(zip(start[kept].tolist(), stop[kept].tolist()))


def _look_up(ranked: DataFrame, wanted: list[tuple], reference: str, target: str) -> dict:
    """cut number -> (j, nn1, nn2, pp1, pp2) of the smallest j of its ranges at which the rates have crossed."""
    asked = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(("i", "n1", "n2", "start", "stop"), w)]) for w in wanted])
    is_ref = F.col("grp") == reference
    place = lambda w: F.when(is_ref, w["n2"] - F.col("k")).otherwise(F.col("k") - w["n1"])
    inside = lambda w: (place(w) >= w["start"]) & (place(w) <= w["stop"])
    near = None
    for _, n1, n2, start, stop in wanted:  # said plainly as well, so that files and row groups can be skipped
        mine = ((F.col("grp") == target) & F.col("k").between(n1 + start, n1 + stop)) | (is_ref & F.col("k").between(n2 - stop, n2 - start))
        near = mine if near is None else near | mine
    rows = ranked.where(near).select("grp", "k", _rate().alias("rate"), F.explode(F.filter(asked, inside)).alias("w"))
    rows = rows.select("grp", F.col("w.i").alias("i"), place(F.col("w")).alias("j"), "k", "rate")
    one = rows.where(~is_ref).select("i", "j", F.col("k").alias("nn1"), F.col("rate").alias("pp1"))
    two = rows.where(is_ref).select("i", "j", F.col("k").alias("nn2"), F.col("rate").alias("pp2"))
    best = one.join(two, ["i", "j"]).where("pp1 >= pp2").groupBy("i").agg(F.min_by(F.struct("j", "nn1", "nn2", "pp1", "pp2"), "j").alias("b"))
    return {r["i"]: tuple(r["b"]) for r in best.collect()}


def first_crossings(ranked: DataFrame, sizes: list[tuple[int, int]], reference: str, target: str, ranges: int = RANGES, ahead: int = AHEAD) -> list:
    """For each (n1, n2) of ``sizes`` the smallest j >= 2 for which the first n1 + j target rows succeed at least as often as the first
    n2 - j reference rows, as (j, n1 + j, n2 - j, rate, rate), or None."""
    step, bounds = range_bounds(ranked, (reference, target), ranges)
    todo = {}
    for i, (n1, n2) in enumerate(sizes):
        if n1 is not None and n2 is not None:
            todo[i] = candidate_ranges(n1, n2, step, bounds[target], bounds[reference])
    found = {}
    while any(todo.values()):
        wanted = [(i, *sizes[i], start, stop) for i, parts in todo.items() for start, stop in parts[:ahead]]
        found |= _look_up(ranked, wanted, reference, target)
        todo = {i: parts[ahead:] for i, parts in todo.items() if i not in found}
        ahead *= 4  # what is left is likely to have no crossing nearby
    return [found.get(i) for i in range(len(sizes))]
