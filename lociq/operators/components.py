"""Connected components by alternating large-star and small-star rounds, all of it distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.session import materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kids = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kids.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _is_star_forest(e: DataFrame) -> bool:
    """No node is both a child and a parent, and none has two parents: every root is the least node of its component."""
    sides = e.select(F.col("a").alias("x"), F.lit(1).alias("kid"), F.lit(0).alias("top")).unionByName(e.select(F.col("b").alias("x"), F.lit(0).alias("kid"), F.lit(1).alias("top")))
    torn = sides.groupBy("x").agg(F.sum("kid").alias("kid"), F.max("top").alias("top")).where("kid + top > 1")
    return torn.isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the least node of it. Nulls and self loops are dropped.

    Each round is two star steps written to the shared folder, so a lost executor costs one round at most; rounds go on
    until the edges are stars. A hot node is aggregated map-side (min) and joined back by a plain equi-join that adaptive
    execution may split."""
    e = materialize(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    while not _is_star_forest(e):
        e = materialize(_small_star(_large_star(e)), "cc")
    kids = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return kids.unionByName(roots)
