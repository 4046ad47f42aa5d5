"""Aggregates over walks, layers and reads, as DataFrame to DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.session import materialize


def r6(c) -> F.Column:
    """Rounded half up to six decimals, as both engines can."""
    return F.floor(c * 1000000 + 0.5) / 1000000


def mean6(c: str) -> F.Column:
    """Mean of values of six decimals, rounded half up in whole millionths."""
    return F.expr(f"((2 * sum(cast(rint({c} * 1000000) as bigint)) + count(*)) div (2 * count(*))) / 1000000")


def adjacency(steps: DataFrame) -> DataFrame:
    """(a, b, n): unordered neighbours on walks with their traversals; equal ends are no link."""
    nxt = F.lead("seg_id").over(Window.partitionBy("contig").orderBy("pos"))
    return neighbours(steps.select(F.col("seg_id").alias("u"), nxt.alias("v")))


def neighbours(links: DataFrame) -> DataFrame:
    """adjacency() of links (u, v)."""
    d = links.where("u <> v")
    return d.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count("*").alias("n"))


def incidence(steps: DataFrame) -> DataFrame:
    """(seg_id, contig, covered): covered bp of each walk on each segment, revisits included."""
    return steps.groupBy("seg_id", "contig").agg(F.sum("bp").alias("covered"))


def geometry(rep: DataFrame) -> DataFrame:
    """(layer, node, leaves, bp, cx, cy, radius, angle): moments of the leaves below each node."""
    g = rep.groupBy("layer", "node").agg(
        F.count("*").alias("leaves"), F.sum("bp").alias("bp"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"),
        (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"),
    )
    angle = F.when(F.col("leaves") > 1, 0.5 * F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy"))).otherwise(0.0)
    return g.select("layer", "node", "leaves", "bp", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"), r6(F.greatest(0.5 * F.greatest("w", "h"), F.lit(0.001))).alias("radius"), r6(angle).alias("angle"))


def layer_coverage(steps: DataFrame, rep: DataFrame, key: str = "contig") -> DataFrame:
    """(layer, node, key, cov): coverage as a fraction of 255, repeats counted, half to even, clipped to 1..255."""
    covered = steps.groupBy("seg_id", key).agg(F.sum("bp").alias("covered"))  # folded before it meets the layers
    size = rep.groupBy("layer", "node").agg(F.sum("bp").alias("size"))
    per = covered.join(rep.select("seg_id", "layer", "node"), "seg_id").groupBy("layer", "node", key).agg(F.sum("covered").alias("covered"))
    return per.join(size, ["layer", "node"]).select("layer", "node", key, F.greatest(F.lit(1), F.least(F.lit(255), F.rint(255.0 * F.col("covered") / F.col("size")).cast("long"))).cast("long").alias("cov"))


def layer_edges(pairs: DataFrame, rep: DataFrame) -> DataFrame:
    """(layer, source, target, n): distinct pairs of representatives with the traversals of the links they stand for."""
    a = rep.select(F.col("seg_id").alias("a"), "layer", F.col("node").alias("na"))
    b = rep.select(F.col("seg_id").alias("b"), "layer", F.col("node").alias("nb"))
    d = pairs.join(a, "a").join(b, ["b", "layer"]).where("na <> nb")
    return d.groupBy("layer", F.least("na", "nb").alias("source"), F.greatest("na", "nb").alias("target")).agg(F.sum("n").alias("n"))


def reference(steps: DataFrame, rep: DataFrame) -> DataFrame:
    """(layer, node, ref_bp, ref_bp_end, ref_contig, ref_multi, is_anchor, ref_strand) from the reference walks."""
    hits = steps.groupBy("seg_id").agg(F.min("start").alias("s"), F.max("stop").alias("e"), F.min("contig").alias("c0"), F.max("contig").alias("c1"), F.count("*").alias("n"), F.sum(F.col("ori") * F.col("bp")).alias("fwd"), F.sum("bp").alias("bp_all"))
    d = hits.join(rep.select("seg_id", "layer", "node"), "seg_id").groupBy("layer", "node")
    d = d.agg(F.min("s").alias("ref_bp"), F.max("e").alias("ref_bp_end"), F.min("c0").alias("ref_contig"), F.max("c1").alias("c1"), F.max("n").alias("n"), F.sum("fwd").alias("fwd"), F.sum("bp_all").alias("bp_all"))
    multi = ((F.col("n") > 1) | (F.col("ref_contig") != F.col("c1"))).cast("long")
    return d.select("layer", "node", "ref_bp", "ref_bp_end", "ref_contig", multi.alias("ref_multi"), (1 - multi).alias("is_anchor"), (2 * F.col("fwd") >= F.col("bp_all")).cast("long").alias("ref_strand"))


def flood(pairs: DataFrame, seed: int, hops: int, most: int | None = None) -> DataFrame:
    """(seg_id, hop): least number of links from the seed, direction ignored; one join and one anti-join a hop. With most,
    no hop follows the one that has gone beyond that many segments."""
    both = materialize(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    spark = pairs.sparkSession
    seen = spark.createDataFrame([(seed, 0)], "seg_id long, hop long")
    rim = seen
    for h in range(1, hops + 1):
        rim = rim.join(both, rim["seg_id"] == both["a"]).select(F.col("b").alias("seg_id")).distinct().join(seen.select("seg_id"), "seg_id", "left_anti").withColumn("hop", F.lit(h).cast("long"))
        rim = materialize(rim, "rim")
        seen = seen.unionByName(rim)
        if most is not None and seen.count() > most:
            break
    return seen


#: Columns of a node's box.
BOX = ("x_lo", "x_hi", "y_lo", "y_hi")


def boxed(nodes: DataFrame) -> DataFrame:
    """Nodes with the box of centre and radius as columns that a scan can compare."""
    box = (F.col("cx") - F.col("radius"), F.col("cx") + F.col("radius"), F.col("cy") - F.col("radius"), F.col("cy") + F.col("radius"))
    return nodes.select("*", *[c.alias(n) for c, n in zip(box, BOX, strict=True)])


def viewport(nodes: DataFrame, layer, x1: float, x2: float, y1: float, y2: float) -> DataFrame:
    """Boxed nodes of a layer whose box touches the rectangle, borders included; without the boxes."""
    touching = (F.col("x_lo") <= x2) & (F.col("x_hi") >= x1) & (F.col("y_lo") <= y2) & (F.col("y_hi") >= y1)
    return nodes.where((F.col("layer") == layer) & touching).drop(*BOX)


def grid(nodes: DataFrame, x1: float, x2: float, y1: float, y2: float, gw: int, gh: int) -> DataFrame:
    """(gx, gy, n, mx, my, mw): nodes by cell, centres clamped into the rectangle."""
    gx = F.least(F.greatest(F.floor((F.col("cx") - x1) / (x2 - x1) * gw), F.lit(0)), F.lit(gw - 1))
    gy = F.least(F.greatest(F.floor((F.col("cy") - y1) / (y2 - y1) * gh), F.lit(0)), F.lit(gh - 1))
    return nodes.groupBy(gx.cast("long").alias("gx"), gy.cast("long").alias("gy")).agg(F.count("*").alias("n"), mean6("cx").alias("mx"), mean6("cy").alias("my"), (2 * mean6("radius")).alias("mw"))
