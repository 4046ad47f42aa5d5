"""Graphs in GFA text: segments, links and walks, one declarative scan each.

Spark reads the file in splits and keeps the lines of a record type by their first letter; malformed records (too few
fields, segment names that are no integer) are left out, as is what the caller does not ask for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions.names import path_tokens


def _records(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    lines = spark.read.text(path).where(F.substring("value", 1, 2).isin(*[f"{k}\t" for k in kinds]))
    return lines.select(F.split(F.rtrim("value", F.lit("\r\n")), "\t").alias("f"))


def _field(i: int) -> Column:
    return F.get("f", F.lit(i))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(seg_id, bp, seq) of S lines."""
    d = _records(spark, path, "S").where(_field(1).rlike("^[0-9]+$") & _field(2).isNotNull())
    seq = F.trim(_field(2))
    return d.select(_field(1).cast("long").alias("seg_id"), F.length(seq).cast("long").alias("bp"), seq.alias("seq"))


def links(spark: SparkSession, path: str) -> DataFrame:
    """(a, a_ori, b, b_ori, a_side, b_side, overlap) of L lines: a leaves by its side 1 if forward, b is entered by side 0."""
    d = _records(spark, path, "L").where((F.size("f") >= 5) & _field(1).rlike("^[0-9]+$") & _field(3).rlike("^[0-9]+$"))
    plus = lambda i: (_field(i) == "+").cast("long")
    return d.select(
        _field(1).cast("long").alias("a"), plus(2).alias("a_ori"), _field(3).cast("long").alias("b"), plus(4).alias("b_ori"),
        plus(2).alias("a_side"), (1 - plus(4)).alias("b_side"), F.coalesce(_field(5), F.lit("*")).alias("overlap"),
    )


def walks(spark: SparkSession, path: str) -> DataFrame:
    """(name, is_walk, path) of P lines (three fields or more) and W lines (seven or more, named sample#hap#contig)."""
    d = _records(spark, path, "P", "W")
    p = d.where((_field(0) == "P") & (F.size("f") >= 3)).select(_field(1).alias("name"), F.lit(0).cast("long").alias("is_walk"), _field(2).alias("path"))
    w = d.where((_field(0) == "W") & (F.size("f") >= 7)).select(F.concat_ws("#", _field(1), _field(2), _field(3)).alias("name"), F.lit(1).cast("long").alias("is_walk"), _field(6).alias("path"))
    return p.unionByName(w)


def steps(spark: SparkSession, path: str) -> DataFrame:
    """(name, pos, seg_id, ori) of all walks, positions from 1."""
    d = walks(spark, path).select("name", F.posexplode(path_tokens(F.col("path"))).alias("i", "t"))
    return d.select("name", (F.col("i") + 1).cast("long").alias("pos"), "t.seg_id", "t.ori")


def dense_ids(seg: DataFrame) -> DataFrame:
    """(seg_id, dense): ids by rank from 1, from sorted ranges and the number of rows before each; no global window."""
    d = seg.select("seg_id").distinct().repartitionByRange("seg_id").sortWithinPartitions("seg_id").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    from pyspark.sql import Window

    from lociq.session import materialize

    d = materialize(d, "ranked")
    parts = d.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # one row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.join(F.broadcast(parts.select("part", "first", before.alias("before"))), "part").select("seg_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("dense"))
