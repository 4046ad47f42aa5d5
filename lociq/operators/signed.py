"""Signed components: sides of nodes from votes that say `same` or `different`, with the votes that cannot be kept.

Votes are taken strongest first. One that joins two groups fixes how their sides relate; one within a group is kept or not
by what is fixed already. The votes that join groups are the spanning forest of greatest strength, and a forest never
contradicts itself, so the order matters for the forest alone: it grows by rounds in which each group takes its strongest
vote to another group. Sides then come from plain components of a double cover, in which every node stands twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.operators.components import connected_components
from lociq.session import materialize


def forest(votes: DataFrame) -> DataFrame:
    """The rows of votes(a, b, strength, ...) that join groups if taken by falling strength, ties by (a, b). At most one
    row a pair. Rounds: each halves the groups that still have votes at least."""
    left = materialize(votes.where("a <> b"), "votes")
    rank = F.struct((-F.col("strength")).alias("s"), "a", "b")
    taken, groups = None, None
    while not left.isEmpty():
        if groups is None:
            left = materialize(left.withColumn("ga", F.col("a")).withColumn("gb", F.col("b")), "votes")
        ends = left.select(F.col("ga").alias("g"), rank.alias("r")).unionByName(left.select(F.col("gb").alias("g"), rank.alias("r")))
        best = ends.groupBy("g").agg(F.min("r").alias("r")).select("r.a", "r.b").distinct()
        picked = materialize(left.join(best, ["a", "b"], "left_semi").select(*votes.columns), "picked")
        taken = picked if taken is None else taken.unionByName(picked)
        taken = materialize(taken, "forest")
        groups = connected_components(taken.select("a", "b"))
        of = lambda c, g: groups.select(F.col("node").alias(c), F.col("component").alias(g))
        d = left.drop("ga", "gb").join(of("a", "ga"), "a", "left").join(of("b", "gb"), "b", "left")
        d = d.withColumn("ga", F.coalesce("ga", "a")).withColumn("gb", F.coalesce("gb", "b")).where("ga <> gb")
        left = materialize(d, "votes")
    return taken if taken is not None else votes.where(F.lit(False))


def sides(relations: DataFrame) -> DataFrame:
    """(node, component, side, conflict) of relations(a, b, same): side 0 is that of the component's least node, 1 the other;
    conflict = 1 in components that cannot hold all of their relations (their side is null)."""
    two = lambda c, k: F.col(c) * 2 + k
    turn = F.when(F.col("same") == 1, 0).otherwise(1)
    cover = relations.select(two("a", 0).alias("a"), (two("b", 0) + turn).alias("b")).unionByName(relations.select(two("a", 1).alias("a"), (two("b", 1) - turn).alias("b")))
    label = connected_components(cover)
    d = label.groupBy(F.floor(F.col("node") / 2).alias("node")).agg(F.min(F.when(F.col("node") % 2 == 0, F.col("component"))).alias("l0"), F.min(F.when(F.col("node") % 2 != 0, F.col("component"))).alias("l1"))
    clash = F.col("l0") == F.col("l1")
    side = F.when(clash, None).when(F.col("l0") < F.col("l1"), 0).otherwise(1).cast("long")
    return d.select("node", F.floor(F.least("l0", "l1") / 2).alias("component"), side.alias("side"), clash.cast("long").alias("conflict"))


def settle(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """votes(a, b, same, strength) -> (node, component, side), and votes with kept = 1 if the sides agree with them."""
    tree = forest(votes)
    node = materialize(sides(tree).select("node", "component", "side"), "sides")
    of = lambda c: node.select(F.col("node").alias(c), F.col("side").alias(f"s_{c}"))
    d = votes.where("a <> b").join(of("a"), "a").join(of("b"), "b")
    kept = ((F.col("s_a") == F.col("s_b")) == (F.col("same") == 1)).cast("long")
    return node, d.select(*votes.columns, kept.alias("kept"))
