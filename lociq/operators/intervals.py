"""Interval joins, as-of lookups and islands. All shuffle on a key of bounded groups; nothing is broadcast by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], mine: tuple[str, str], theirs: tuple[str, str], width: int) -> DataFrame:
    """Pairs of half-open intervals that overlap, each pair once.

    Both sides are laid out over bins of `width`, so the join is an equi-join on (on, bin) and a long contig spreads over
    many tasks; a pair counts in the bin where its overlap starts. Empty intervals overlap nothing."""

    def laid(d: DataFrame, start: str, stop: str) -> DataFrame:
        return d.where(F.col(start) < F.col(stop)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width))))

    (a, b), (c, d) = mine, theirs
    both = laid(left, a, b).join(laid(right, c, d), [*on, "_bin"])
    hit = (F.col(a) < F.col(d)) & (F.col(b) > F.col(c)) & (F.col("_bin") == F.floor(F.greatest(a, c) / width))
    return both.where(hit).drop("_bin")


def last_at(points: DataFrame, marks: DataFrame, on: list[str], at: str, mark_at: str, value: str) -> DataFrame:
    """points with the value of the last mark at or before each of them; before the first mark, that of the first."""
    p = points.select(*on, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_p"), F.lit(None).cast(marks.schema[value].dataType).alias("_v"))
    m = marks.select(*on, F.col(mark_at).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.col(value).alias("_v"))
    w = Window.partitionBy(*on).orderBy("_at", "_kind")
    before = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_v", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return p.unionByName(m).withColumn("_v", F.coalesce(before, after)).where("_kind = 1").select("_p.*", F.col("_v").alias(value))


def islands(rows: DataFrame, keys: list[str], start: str, stop: str, gap: int = 0) -> DataFrame:
    """rows with `island`, counted from 1 within keys: a row joins the island before it if it starts at most gap behind its end."""
    w = Window.partitionBy(*keys).orderBy(start, stop)
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) <= reach + gap, 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")
