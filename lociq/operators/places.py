"""Nearest places by two quadtrees.

Marks and points are cut into cells that halve in both directions until a cell holds LEAF places at most, so cells are
small where places are dense. Leaf cells of the points walk down the marks' tree together: a cell of marks stays a
candidate as long as its least distance does not exceed the distance within which the other candidates are sure to hold k
marks. Only then are points and marks of the cells that are left compared. Every step is a join by cell and a window over
one cell's candidates; work follows the number of cells, whatever the spread of the places.

Places at one spot are folded first, so that a spot with most of the rows is one point, and k marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.session import materialize

#: Places of a leaf cell; halvings of the sides of all places at most.
LEAF, DEPTH = 16, 26

_FINITE = "x is not null and y is not null and not isnan(x) and not isnan(y) and abs(x) < double('infinity') and abs(y) < double('infinity')"


def _length(metric: str, dx: Column, dy: Column) -> Column:
    return F.hypot(dx, dy) if metric == "straight" else F.greatest(dx, dy)


def _grid(rows: DataFrame, box: DataFrame) -> DataFrame:
    """rows(x, y) with the column and line of the finest cells, gx and gy."""
    cells = 1 << DEPTH
    at = lambda c: F.least(F.lit(cells - 1), F.floor((F.col(c) / F.col("_side") - F.col(f"_{c}0")) * cells)).cast("long")
    return rows.crossJoin(F.broadcast(box)).withColumn("gx", at("x")).withColumn("gy", at("y")).drop("_x0", "_y0", "_side")  # one row


def _number(level: str, cx: str, cy: str) -> Column:
    """A cell's number: its level, column and line side by side."""
    return F.expr(f"shiftleft(cast({level} as bigint), {2 * DEPTH}) + shiftleft(cast({cx} as bigint), {DEPTH}) + {cy}")


def _nodes(rows: DataFrame) -> DataFrame:
    """(no, up, level, n, x0, x1, y0, y1, leaf): the cells of a quadtree with the boxes of what they hold; up: the cell above."""
    at = rows.select("x", "y", "gx", "gy", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level"))
    cell = [F.expr(f"shiftright(g{c}, {DEPTH} - level)").alias(f"c{c}") for c in "xy"]
    cells = at.select("level", *cell, "x", "y").groupBy("level", "cx", "cy").agg(
        F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    # What four neighbours hold is what the cell above holds; below a leaf there is nothing.
    cells = cells.withColumn("up", F.when(F.col("level") > 0, _number("level - 1", "shiftright(cx, 1)", "shiftright(cy, 1)")))
    cells = cells.withColumn("above", F.sum("n").over(Window.partitionBy("level", "up"))).where(f"level = 0 or above > {LEAF}")
    return cells.select(_number("level", "cx", "cy").alias("no"), "up", "level", "n", "x0", "x1", "y0", "y1", ((F.col("n") <= LEAF) | (F.col("level") == DEPTH)).alias("leaf"))


def _in_leaf(rows: DataFrame, leaves: DataFrame, levels: list[int], name: str) -> DataFrame:
    """rows with the leaf cell that holds each."""
    at = rows.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    at = at.withColumn(name, _number("level", f"shiftright(gx, {DEPTH} - level)", f"shiftright(gy, {DEPTH} - level)"))
    return at.join(leaves.select(F.col("no").alias(name)), name).drop("level", "gx", "gy")


def nearest(points: DataFrame, marks: DataFrame, k: int = 1, metric: str = "straight") -> DataFrame:
    """(x, y, mark, dist, rank): for each spot of points(x, y) the k nearest of marks(mark, x, y), all if fewer, ties to the
    smaller mark. metric: "straight", or "square" for the greater of both differences. Places that are null or not finite
    take no part; each row of marks counts."""
    spots = points.where(_FINITE).select("x", "y").distinct()
    same = Window.partitionBy("x", "y").orderBy("mark")
    kept = marks.where(_FINITE).select("mark", "x", "y").withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k).drop("_r")
    both = points.where(_FINITE).select("x", "y").unionByName(marks.where(_FINITE).select("x", "y"))
    # In units of the side, so that no difference leaves the range of doubles.
    side = F.greatest(F.max("x") / 2 - F.min("x") / 2, F.max("y") / 2 - F.min("y") / 2)
    box = both.agg(F.min("x").alias("_lx"), F.min("y").alias("_ly"), F.when(side > 0, side * 2).otherwise(1.0).alias("_side"))
    box = box.select((F.col("_lx") / F.col("_side")).alias("_x0"), (F.col("_ly") / F.col("_side")).alias("_y0"), "_side")
    spots, kept = materialize(_grid(spots, box), "spots"), materialize(_grid(kept, box), "marks")
    own = materialize(_nodes(spots).where("leaf"), "cells")
    tree = materialize(_nodes(kept), "tree")
    kinds = tree.groupBy("level", "leaf").count().collect()  # at most two rows a level
    deep = max((r["level"] for r in kinds), default=0)

    pair = ["q", "qx0", "qx1", "qy0", "qy1"]
    far = _length(metric, F.greatest(F.col("x1") - F.col("qx0"), F.col("qx1") - F.col("x0")), F.greatest(F.col("y1") - F.col("qy0"), F.col("qy1") - F.col("y0")))
    zero = F.lit(0.0)
    near = _length(metric, F.greatest(zero, F.col("x0") - F.col("qx1"), F.col("qx0") - F.col("x1")), F.greatest(zero, F.col("y0") - F.col("qy1"), F.col("qy0") - F.col("y1")))
    asked = own.select(F.col("no").alias("q"), *[F.col(c).alias(f"q{c}") for c in ("x0", "x1", "y0", "y1")])
    held = ["no", "n", "x0", "x1", "y0", "y1"]
    # A step leads from a cell to its parts, and from a leaf to itself.
    steps = tree.where("level > 0").select("up", *held).unionByName(tree.where("leaf").select(F.col("no").alias("up"), *held))
    now = asked.crossJoin(F.broadcast(tree.where("level = 0").select(F.col("no").alias("up"))))  # one row
    sure = Window.partitionBy("q").orderBy("far", "no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(1, deep + 1):
        now = now.join(steps, "up").withColumn("far", far).withColumn("near", near).withColumn("sum", F.sum("n").over(sure))
        most = F.min(F.when(F.col("sum") >= k, F.col("far"))).over(Window.partitionBy("q"))
        now = now.withColumn("most", most).where("most is null or near <= most * (1 + 1e-9)").select(*pair, F.col("no").alias("up"))
        if level % 6 == 0:
            now = materialize(now, "candidates")
    pairs = materialize(now.select("q", F.col("up").alias("m")), "candidates")
    here = _in_leaf(spots, own, sorted({r["level"] for r in own.select("level").distinct().collect()}), "q")  # at most DEPTH + 1 rows
    there = _in_leaf(kept, tree.where("leaf"), sorted({r["level"] for r in kinds if r["leaf"]}) or [0], "m").select("m", "mark", F.col("x").alias("mx"), F.col("y").alias("my"))
    dist = _length(metric, F.abs(F.col("mx") - F.col("x")), F.abs(F.col("my") - F.col("y")))
    met = pairs.join(there, "m").join(here, "q").select("x", "y", "mark", dist.alias("dist"))
    best = Window.partitionBy("x", "y").orderBy("dist", "mark")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
