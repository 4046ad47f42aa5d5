"""Pivot distances and the plane they span: a start for a layout.

Pivots are spread out: each is a node as far from all earlier ones as any (ties to the smaller id). Distances are hops,
found by frontiers. The links are dealt out by their node once and stay where they are: a hop sends the frontier to them
and the nodes that it finds on. The plane is that of the two greatest axes of the double-centred squared distances; only a
matrix of pivots x pivots reaches the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.session import bucketed, materialize, sized


def hops(links: DataFrame, every: DataFrame, seed: int) -> DataFrame:
    """(node, hop) of all nodes of every(node, degree) that links(u, v), both directions given and none twice, reach from
    seed; both tables are best bucketed by u and by node.

    A hop goes from the frontier's links to the nodes at their ends, or, where those not yet reached have fewer links, from
    these to the frontier, so that the last hops, when little is left, cost little."""
    rim = materialize(every.where(F.col("node") == seed).withColumn("hop", F.lit(0).cast("long")), "rim")
    seen, parts, h = rim.select("node", "hop"), 1, 0
    out, left = _links_of(rim), _links_of(every)
    left -= out
    while out and left:
        h += 1
        # Hints: neither side of a join is sent to all, and the links are never sorted.
        rest = every.join(seen.select("node"), "node", "left_anti")
        if out <= 2 * left:  # a link that asks is sent with both of its ends
            ends = links.join(rim.select(F.col("node").alias("u")).hint("shuffle_hash"), "u", "left_semi").select(F.col("v").alias("node"))
        else:
            asking = links.join(rest.select(F.col("node").alias("u")).hint("shuffle_hash"), "u", "left_semi")
            ends = asking.join(rim.select(F.col("node").alias("v")).hint("shuffle_hash"), "v", "left_semi").select(F.col("u").alias("node"))
        rim = materialize(rest.join(ends.distinct(), "node", "left_semi").withColumn("hop", F.lit(h).cast("long")), "rim")
        out = _links_of(rim)
        left -= out
        seen, parts = seen.unionByName(rim.select("node", "hop")), parts + 1
        if parts == 16:
            seen, parts = materialize(seen, "seen"), 1
    return seen


def _links_of(nodes: DataFrame) -> int:
    return nodes.agg(F.sum("degree")).first()[0] or 0


def pivots(pairs: DataFrame, k: int) -> DataFrame:
    """(node, pivot, hop) for at most k pivots of pairs(a, b), numbered from 0: the first is the least node; nodes that a
    pivot does not reach have no row for it and count as farthest. No pairs, no rows."""
    spark = pairs.sparkSession
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v")
    out = spark.createDataFrame([], "node long, pivot long, hop long")
    # Dealt out by u, equal links meet: dropping repeats needs no other shuffle.
    with sized(spark, 2 * pairs.count()), bucketed(both, "u", "links", lambda d: d.distinct()) as links, bucketed(links.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree")), "node", "nodes") as every:
        seed = every.agg(F.min("node")).first()[0]
        near = every.select("node", F.lit(None).cast("long").alias("near"))
        for i in range(k):
            if seed is None:
                break
            d = materialize(hops(links, every, seed), "hops")
            out = out.unionByName(d.select("node", F.lit(i).cast("long").alias("pivot"), "hop"))
            near = materialize(near.join(d, "node", "left").select("node", F.least("near", "hop").alias("near")), "near")
            # Beyond all pivots first, then the farthest.
            far = near.agg(F.min(F.struct(F.col("near").isNotNull().alias("met"), (-F.col("near")).alias("d"), "node")).alias("x")).first()["x"]
            seed = None if far is None or far["met"] and far["d"] == 0 else far["node"]
    return out


def plane(distances: DataFrame) -> DataFrame:
    """(node, x, y) of the nodes of distances(node, pivot, hop) that every pivot reaches: the projection of the
    double-centred squares on their two greatest axes. An axis points to where its largest coefficient is positive."""
    at = sorted(x.pivot for x in distances.select("pivot").distinct().collect())  # one row a pivot
    k = len(at)
    if not k:
        return distances.select("node", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    # A node's distances meet once; a row holds them all from there on.
    s = [F.max(F.when(F.col("pivot") == p, F.col("hop") * F.col("hop"))).cast("double").alias(f"p{i}") for i, p in enumerate(at)]
    wide = distances.repartition("node").groupBy("node").agg(*s).where(" and ".join(f"p{i} is not null" for i in range(k)))
    wide = materialize(wide, "wide")
    col = [x or 0.0 for x in wide.agg(*[F.avg(f"p{i}") for i in range(k)]).first()]
    every = sum(col) / k
    row = sum((F.col(f"p{i}") for i in range(1, k)), F.col("p0")) / k
    centred = wide.select("node", *[(-0.5 * (F.col(f"p{i}") - row - F.lit(col[i]) + F.lit(every))).alias(f"c{i}") for i in range(k)])
    cells = [F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
    m = centred.agg(*cells).first()  # pivots x pivots
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = m[f"m{i}_{j}"] or 0.0
    _, v = np.linalg.eigh(cov)
    axes = [v[:, -1 - i] * (1 if v[np.argmax(abs(v[:, -1 - i])), -1 - i] > 0 else -1) if i < k else np.zeros(k) for i in range(2)]
    along = lambda a: sum((F.col(f"c{i}") * F.lit(float(a[i])) for i in range(k)), F.lit(0.0))
    return centred.select("node", along(axes[0]).alias("x"), along(axes[1]).alias("y"))
