"""Sparse lists of (id, value) pairs, asked by ranges of ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Ranges = list[tuple[int, int]]


def parse_ranges(text: str, most: int = 4096) -> Ranges | None:
    """`0-23,24-33` as pairs; None (no filter) if it is malformed, empty or names more than `most` ranges."""
    out: Ranges = []
    for part in text.split(","):
        lo, dash, hi = part.strip().partition("-")
        if not lo.isdigit() or (dash and not hi.isdigit()):
            return None
        out.append((int(lo), int(hi) if dash else int(lo)))
        if out[-1][0] > out[-1][1]:
            return None
    return out if 0 < len(out) <= most else None


def in_ranges(id_: Column, ranges: Ranges) -> Column:
    """The id lies in one of the ranges, ends included."""
    hit = F.lit(False)
    for lo, hi in ranges:
        hit = hit | id_.between(lo, hi)
    return hit


def range_any(items: Column, ranges: Ranges) -> Column:
    """Whether an array of structs with `id` has an id in the ranges."""
    return F.exists(items, lambda x: in_ranges(x["id"], ranges))


def range_max(items: Column, ranges: Ranges) -> Column:
    """Largest `value` of the ids in the ranges, -1 if none; 255 for an item without a value."""
    kept = F.filter(items, lambda x: in_ranges(x["id"], ranges))
    return F.coalesce(F.array_max(F.transform(kept, lambda x: F.coalesce(x["value"], F.lit(255).cast("long")))), F.lit(-1).cast("long"))


def range_sum(items: Column, ranges: Ranges) -> Column:
    """Sum of `value` over the ids in the ranges."""
    return F.aggregate(F.filter(items, lambda x: in_ranges(x["id"], ranges)), F.lit(0).cast("long"), lambda s, x: s + x["value"])


def selection_mask(ranges: Ranges, words: int, n_ids: int) -> tuple[list[int], bool]:
    """Signed 64-bit mask words of the selected ids and whether the mask decides alone (one bit an id) or only rules out."""
    exact = n_ids <= 64 * words
    out = [0] * words
    for lo, hi in ranges:
        for i in range(lo, min(hi, n_ids - 1) + 1):
            b = i if exact else i % (64 * words)
            out[b // 64] |= 1 << (b % 64)
    return [x - (1 << 64) if x >> 63 else x for x in out], exact
