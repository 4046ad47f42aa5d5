"""Rows for intervals, so that none overlap in a row and no more rows are used than intervals lie over one place.

Intervals are swept by start; each takes the lowest row that is free. Keys are dealt out by ranges and swept as they lie.
Where nothing lies over a place all rows are free, so what stands between two such places is packed by itself: a key of
more than HOT intervals is many groups. A task holds the ends of the rows in use, as many as intervals overlap."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.session import materialize, partitions

#: Intervals of a key that one task sweeps.
HOT = 200_000


def _swept(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals in order of (key, island, start, stop, id) -> each with its row."""
    now, free, busy, rows = None, [], [], 0
    for b in it:
        out = []
        for key, island, start, stop in zip(*(b.column(n).to_pylist() for n in ("key", "island", "start", "stop")), strict=True):
            if (key, island) != now:
                now, free, busy, rows = (key, island), [], [], 0
            while busy and busy[0][0] <= start:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                row = heapq.heappop(free)
            else:
                row, rows = rows, rows + 1
            heapq.heappush(busy, (stop, row))
            out.append(row + 1)
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), pa.array(out, pa.int64())], names=["key", "id", "line"])


def pack(intervals: DataFrame) -> DataFrame:
    """(key, id, line) of intervals(key, id, start, stop), half open and not empty; lines count from 1. Dealt out by ranges of
    the key and sorted by key and line."""
    d = intervals.where("start < stop").select("key", "id", "start", "stop")
    many = d.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key")
    if many.isEmpty():
        return _by_key(d)
    many = F.broadcast(materialize(many, "hot"))  # one row for HOT intervals at most
    return _by_key(d.join(many, "key", "left_anti")).unionByName(_by_island(d.join(many, "key", "left_semi")))


def _by_key(d: DataFrame) -> DataFrame:
    """pack() with each key swept by one task: one shuffle."""
    d = d.repartitionByRange("key").select("key", "id", F.lit(0).alias("island"), "start", "stop").sortWithinPartitions("key", "start", "stop", "id")
    return d.mapInArrow(_swept, "key long, id long, line long").sortWithinPartitions("key", "line")


def _by_island(d: DataFrame) -> DataFrame:
    """pack() with each key swept in as many groups as there are places in it that nothing lies over."""
    by = Window.partitionBy("key").orderBy("start", "stop", "id")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_new", F.when(F.col("start") < reach, 0).otherwise(1))
    d = d.withColumn("island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    d = d.select("key", "id", "island", "start", "stop").repartition(partitions(d.sparkSession), "key", "island").sortWithinPartitions("key", "island", "start", "stop", "id")
    return d.mapInArrow(_swept, "key long, id long, line long").repartitionByRange("key", "line").sortWithinPartitions("key", "line")
