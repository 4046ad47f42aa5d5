"""From a weighted tree to layers: thresholds, lives of nodes, zoom factors, descendants and edits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.functions.scales import half_up


def targets(total: int, floor: int = 1000, ratio: float = 2.5) -> list[int]:
    """Nodes to aim at by layer, coarsest first: each layer has less than the next by a ratio that falls towards 2."""
    out = [total]
    while out[0] > floor:
        out.insert(0, math.ceil(out[0] / ratio))
        ratio = max(2.0, ratio * 0.8)
    return out


def thresholds(tree: DataFrame, aims: Sequence[int]) -> list[int]:
    """The largest weight threshold of each layer at which at least so many nodes are alive, strictly falling, the last 1.

    tree(weight, parent_weight); the histogram of distinct weights decides, aggregated before it reaches the driver: it
    has as many rows as there are different weights."""
    big = (1 << 62)
    born = tree.groupBy(F.coalesce("parent_weight", F.lit(big)).alias("w")).agg(F.count("*").alias("n")).withColumn("side", F.lit(1))
    gone = tree.groupBy(F.col("weight").alias("w")).agg(F.count("*").alias("n")).withColumn("side", F.lit(-1))
    rows = sorted((r["w"], r["n"] * r["side"]) for r in born.unionByName(gone).collect())
    # Alive at t: weight <= t < parent weight. count(t) = #{parent > t} - #{weight > t}.
    values = sorted({w for w, _ in rows if w < big})
    ends = [v - 1 for v in values[1:]] + values[-1:]  # between two weights nothing changes: the largest threshold of each stretch
    count, above, at = {}, 0, len(rows) - 1
    for t in reversed(ends):
        while at >= 0 and rows[at][0] > t:
            above += rows[at][1]
            at -= 1
        count[t] = above
    out: list[int] = []
    for aim in aims[:-1]:
        below = out[-1] if out else big
        fit = [min(e, below - 1) for v, e in zip(values, ends, strict=True) if count[e] >= aim and v < below]
        if fit and fit[-1] > 1:
            out.append(fit[-1])
    return [*out, 1]


def lives(tree: DataFrame, theta: Sequence[int]) -> DataFrame:
    """tree with birth and death: the layers [birth, death) in which a node is drawn; death is null for leaves (weight 1),
    birth is null for nodes of no layer."""
    layers = F.array(*[F.lit(t) for t in theta])
    alive = F.filter(F.transform(layers, lambda t, i: F.when((F.col("weight") <= t) & (t < F.coalesce("parent_weight", F.lit(1 << 62))), i)), lambda i: i.isNotNull())
    born, last = F.array_min(alive).cast("long"), F.array_max(alive).cast("long")
    return tree.withColumn("birth", born).withColumn("death", F.when((F.col("weight") > 1) | (last < len(theta) - 1), last + 1))


def span_weight(size, span, total, root_span, strength: float = 1.0) -> F.Column:
    """The weight of a node: its leaves, or its share of the whole extent if that is more."""
    return F.greatest(size, F.rint(F.lit(strength) * total * span / root_span).cast("long"))


def zoom_factors(scale: Sequence[float], n: Sequence[int]) -> list[float]:
    """The zoom at which each layer takes over: scale relative to the first, rising by a least ratio and at most fourfold."""
    out: list[float] = []
    seen = False
    for s, m in zip(scale, n, strict=True):
        f = s / scale[0]
        if out and (seen or f > 1):
            seen = True
            least = max(1.10, math.sqrt(m / n[len(out) - 1]))
            f = max(f, out[-1] * least)
            if least <= 4:
                f = min(f, 4 * out[-1])
        out.append(round(f, 6))
    return out


def choose_layer(zoom: float, factors: Sequence[float], safe: int) -> int:
    """The deepest layer whose factor the zoom has reached, not below the safe one."""
    return min(max([i for i, f in enumerate(factors) if f <= zoom], default=0), safe)


def descendants(closure: DataFrame, names: Sequence[str]) -> DataFrame:
    """(node) of the named nodes and all below them; closure(node, ancestor)."""
    return closure.where(F.col("ancestor").isin(*names)).select("node").distinct()


def apply_gestures(nodes: DataFrame, closure: DataFrame, gestures: Sequence[dict]) -> DataFrame:
    """(layer, node, x, y, angle) of all nodes that the gestures move, in all layers, in turn.

    A gesture is {names, turn, dx, dy}: a rigid turn about the origin and a shift; one without names, or with a value
    that is no finite number, is skipped. Gestures are folded into one expression, so the nodes are read once."""
    good = [g for g in gestures if g.get("names") and all(isinstance(g.get(k), int | float) and math.isfinite(g[k]) for k in ("turn", "dx", "dy"))]
    touched = None
    for i, g in enumerate(good):
        d = descendants(closure, g["names"]).select("node", F.lit(i).alias("g"))
        touched = d if touched is None else touched.unionByName(d)
    if touched is None:
        return nodes.where("false").select("layer", "node", F.col("cx").alias("x"), F.col("cy").alias("y"), "angle")
    by_node = touched.groupBy("node").agg(F.collect_set("g").alias("gs"))  # no more than the gestures
    x, y, angle = F.col("cx"), F.col("cy"), F.col("angle")
    for i, g in enumerate(good):
        on = F.array_contains("gs", F.lit(i))
        c, s = math.cos(g["turn"]), math.sin(g["turn"])
        x, y, angle = (
            F.when(on, half_up(F.lit(c) * x - F.lit(s) * y + F.lit(float(g["dx"])))).otherwise(x),
            F.when(on, half_up(F.lit(s) * x + F.lit(c) * y + F.lit(float(g["dy"])))).otherwise(y),
            F.when(on, half_up(angle + F.lit(float(g["turn"])))).otherwise(angle),
        )
    return nodes.join(by_node, "node").select("layer", "node", x.alias("x"), y.alias("y"), angle.alias("angle"))


def chunks(df: DataFrame, by: str, order: str, weight: str, most: int) -> DataFrame:
    """df with chunk: runs in order whose weights add up to about `most`, by the running sum before each row."""
    from pyspark.sql import Window

    before = F.sum(weight).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(weight)
    return df.withColumn("chunk", F.floor(before / F.lit(most)).cast("long"))
