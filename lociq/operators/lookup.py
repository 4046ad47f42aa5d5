"""Searches and lookups over nodes, with their caps as parameters and a flag where a cap has cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.operators import places


def capped(df: DataFrame, most: int, *order: str) -> DataFrame:
    """The first `most` rows in this order, with truncated = 1 if there were more: one row beyond the cap is looked at."""
    top = df.orderBy(*order).limit(most + 1).withColumn("_r", F.row_number().over(Window.orderBy(*order)))  # at most most + 1 rows
    return top.withColumn("truncated", (F.max("_r").over(Window.partitionBy(F.lit(1))) > most).cast("long")).where(F.col("_r") <= most).drop("_r")


def capped_counts(nodes: DataFrame, cap: int) -> DataFrame:
    """(layer, n, capped): nodes of each layer, counted no further than the cap says."""
    return nodes.groupBy("layer").agg(F.count("*").alias("n")).select("layer", F.least("n", F.lit(cap)).cast("long").alias("n"), (F.col("n") >= cap).cast("long").alias("capped"))


def deepest(nodes: DataFrame) -> DataFrame:
    """The deepest row of each name."""
    w = Window.partitionBy("node").orderBy(F.col("layer").desc())
    return nodes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def goto(reference: DataFrame, contig: int, target: int) -> DataFrame:
    """(target, layer, node, off) of a position of a reference contig: the deepest node that contains it (off 0), else
    the node that starts nearest, unambiguous ones first (off 1). Both are range filters on the stored table; the nearest
    is only looked for on the contig."""
    d = reference.where(F.col("ref_contig") == contig)
    inside = (F.col("ref_bp") <= target) & (F.coalesce("ref_bp_end", "ref_bp") >= target)
    rank = F.struct(
        F.when(inside, 0).otherwise(1).cast("long").alias("off"), F.when(inside, -F.col("layer")).otherwise(F.abs(F.col("ref_bp") - target)).alias("key"),
        F.col("ref_multi"), (-F.col("layer")).alias("up"), F.col("node"),
    )
    return d.agg(F.min(rank).alias("b")).where("b is not null").select(F.lit(target).cast("long").alias("target"), (-F.col("b.up")).alias("layer"), "b.node", "b.off")


def nearest_by(points: DataFrame, marks: DataFrame) -> DataFrame:
    """points(id, x, y) with the nearest of marks(mark, mx, my) and its distance, ties to the smaller mark; null where there
    is no mark, or the point has no place."""
    best = places.nearest(points, marks.select("mark", F.col("mx").alias("x"), F.col("my").alias("y")))
    return points.select("id", "x", "y").join(best.drop("rank"), ["x", "y"], "left").select("id", "mark", "dist")


def kth_distance(points: DataFrame, k: int) -> DataFrame:
    """(id, dist): Chebyshev distance of every point(id, x, y) to the k-th nearest other row; exact. Points with fewer than
    k others have none."""
    # Every point is its own nearest mark, at distance 0.
    best = places.nearest(points, points.select(F.col("id").alias("mark"), "x", "y"), k + 1, "square").where(F.col("rank") == k + 1)
    return points.select("id", "x", "y").join(best.select("x", "y", "dist"), ["x", "y"]).select("id", "dist")
