"""Scales, rulers and curves of the drawing as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 6) -> Column:
    """Rounded half up to so many decimals."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def nice_step(span: Column, ticks: int) -> Column:
    """The least of 1, 2, 5 or 10 times a power of ten that cuts a span into at most so many steps."""
    raw = span / float(ticks)
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    m = raw / power
    return F.when(m <= 1, 1.0).when(m <= 2, 2.0).when(m <= 5, 5.0).otherwise(10.0) * power


def ruler(bp: Column) -> Column:
    """A position for a ruler: Mb, kb or bp with up to three decimals, trailing zeros gone."""
    text = lambda x, unit: F.concat(F.regexp_replace(F.regexp_replace(F.format_string("%.3f", x), "0+$", ""), r"\.$", ""), F.lit(unit))
    return F.when(bp >= 1_000_000, text(bp / 1e6, " Mb")).when(bp >= 1000, text(bp / 1e3, " kb")).otherwise(F.concat(bp.cast("string"), F.lit(" bp")))


def parse_bp(text: str) -> int | None:
    """`12.3Mb`, `800 kb`, `1,234` as bases; None if it is no position."""
    m = re.fullmatch(r"\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*([kKmMgG]?)(?:[bB][pP]?)?\s*", text)
    if not m:
        return None
    return int(float(m[1].replace(",", "")) * {"": 1, "k": 1e3, "m": 1e6, "g": 1e9}[m[2].lower()] + 0.5)


def parse_bp_column(text: Column) -> Column:
    """parse_bp as an expression; null where the text is no position."""
    form = r"^\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*([kKmMgG]?)(?:[bB][pP]?)?\s*$"
    number = F.replace(F.regexp_extract(text, form, 1), F.lit(","), F.lit("")).cast("double")
    unit = F.lower(F.regexp_extract(text, form, 2))
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)
    return F.when(text.rlike(form), F.floor(number * factor + 0.5).cast("long"))


def density_ramp(count: Column, most: Column) -> Column:
    """A count on a logarithmic scale from 0 to 1."""
    return F.when(most > 0, F.least(F.log(1 + count) / F.log(1 + most), F.lit(1.0))).otherwise(F.lit(0.0))


def hilbert(x: Column, y: Column, order: int = 8) -> Column:
    """Distance along the Hilbert curve of cell (x, y) in a square of 2^order cells a side, by quadrants from the top."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def descend(at: Column, side: Column) -> Column:
        right, up = (F.floor(at["x"] / side) % 2) == 1, (F.floor(at["y"] / side) % 2) == 1
        u, v = at["x"] % side, at["y"] % side
        quadrant = F.when(right & up, 2).when(right, 3).when(up, 1).otherwise(0)
        # The lower quadrants are turned: the left one is mirrored on the diagonal, the right one on the other.
        return F.struct(
            F.when(up, u).when(right, side - 1 - v).otherwise(v).cast("long").alias("x"),
            F.when(up, v).when(right, side - 1 - u).otherwise(u).cast("long").alias("y"),
            (at["d"] + side * side * quadrant).cast("long").alias("d"),
        )

    sides = F.array(*[F.lit(1 << i).cast("long") for i in reversed(range(order))])
    return F.aggregate(sides, start, descend, lambda at: at["d"])


def drag_weight(hop: Column, reach: int, power: float = 2.0) -> Column:
    """How far a neighbour follows a dragged node: falls with its hop, 0 beyond the reach."""
    return F.pow(F.greatest(1 - hop / F.lit(float(reach + 1)), F.lit(0.0)), F.lit(power))
