"""Tile keys over all zooms: the bits of column and row interleaved in one number.

The four tiles under a tile have its number followed by two bits, so a parent is a shift, all tiles under one parent are an
interval, and a rectangle of tiles is a few intervals of numbers.  Zoom 0 is the tiles themselves; each zoom above halves
both sides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Steps of spreading 32 bits to every second place: shift, mask.
SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]
BITS = 31  # of a column or row at most


def _spread(index: Column) -> Column:
    out = index.cast("long")
    for shift, keep in SPREAD:
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(keep))
    return out


def _gather(key: Column) -> Column:
    out = key.bitwiseAND(F.lit(SPREAD[-1][1]))
    for i in range(len(SPREAD) - 1, -1, -1):
        keep = SPREAD[i - 1][1] if i else 0x00000000FFFFFFFF
        out = out.bitwiseOR(F.shiftright(out, SPREAD[i][0])).bitwiseAND(F.lit(keep))
    return out.cast("int")


def tile_key(tx: Column, ty: Column) -> Column:
    """The number of a tile with a column and row of 0 or more."""
    return _spread(tx).bitwiseOR(F.shiftleft(_spread(ty), 1))


def key_column(key: Column) -> Column:
    return _gather(key)


def key_row(key: Column) -> Column:
    return _gather(F.shiftright(key, 1))


def parent_key(key: Column, levels: int | Column = 1) -> Column:
    """The tile that many zooms above."""
    return F.shiftright(key, 2 * levels) if isinstance(levels, int) else F.call_function("shiftright", key, (2 * levels).cast("int"))


def intervals(x0: int, y0: int, x1: int, y1: int, most: int = 32) -> list[tuple[int, int]]:
    """Inclusive intervals of keys that hold all tiles of a rectangle (inclusive), in order.

    Squares on the border are divided, all of a size at a time, for as long as no more than ``most`` intervals come of it; so
    the work is bounded by ``most`` and the number of sizes.  Small rectangles come out exact; otherwise some more tiles lie
    in the intervals, and the caller keeps testing column and row."""
    if x0 > x1 or y0 > y1:
        return []
    side = 1
    while side <= max(x1, y1):
        side *= 2
    whole: list[tuple[int, int]] = []
    border = [(0, 0, 0)]  # key, column, row
    found = [(0, side * side - 1)]
    while border and side > 1:
        side //= 2
        parts = [(key + q * side * side, x + (q & 1) * side, y + (q >> 1) * side) for key, x, y in border for q in range(4)]
        parts = [(k, x, y) for k, x, y in parts if x <= x1 and y <= y1 and x + side > x0 and y + side > y0]
        inside = [x0 <= x and y0 <= y and x + side - 1 <= x1 and y + side - 1 <= y1 for _, x, y in parts]
        more = whole + [(k, k + side * side - 1) for (k, _, _), i in zip(parts, inside) if i]
        border = [p for p, i in zip(parts, inside) if not i]
        finer = _joined(more + [(k, k + side * side - 1) for k, _, _ in border])
        if len(finer) > most:
            break
        whole, found = more, finer
    return found


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and out[-1][1] + 1 == low:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def in_intervals(key: Column, ranges: list[tuple[int, int]]) -> Column:
    """Plain comparisons, so a scan of a table kept in key order skips what lies between."""
    out = F.lit(False)
    for low, high in ranges:
        out = out | key.between(low, high)
    return out
