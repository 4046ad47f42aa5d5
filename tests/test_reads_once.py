"""Reads and steps are put in order once: what follows from the order is kept with them, and nobody shuffles them again."""

from __future__ import annotations

import random

import pytest

from lociq import session
from lociq.operators import packing, stretches
from lociq.plans import reading, structure
from lociq.plans.annotations import QUERIES
from lociq.sources import projection as P
from lociq.store import stored

DATA = "/root/testdata/sf0.001"


def _shuffled(spark) -> int:
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_reads_of_a_node_shuffle_only_that_node(spark):
    P.reads(spark, DATA)
    before = _shuffled(spark)
    got = QUERIES["reads_for_node"](spark, DATA).collect()
    assert got and _shuffled(spark) - before <= 2 * len(got)


def test_read_parts_and_packing_take_one_shuffle_each(spark):
    n = P.reads(spark, DATA).count()
    before = _shuffled(spark)
    parts = reading.parts(spark, DATA)
    assert _shuffled(spark) - before <= n + 8
    keys = parts.select("seg_id").distinct().count()
    before = _shuffled(spark)
    assert structure.packed(spark, DATA).count() > 0
    assert _shuffled(spark) - before <= n + 8 * keys + 8


@pytest.mark.parametrize("hot", [10, 400, 10**9])
def test_sums_over_whole_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(stretches, "HOT", hot)
    rows = [(None if i % 3 == 0 else f"k{i % 40 % 7}", i * 7919 % 1000, i) for i in range(1000)]
    total: dict = {}
    for k, _, v in rows:
        total[k] = total.get(k, 0) + v
    d = stretches.along(spark.createDataFrame(rows, "k string, i long, v long"), ["k"], ["i"], {"n": "1"}, whole={"t": "v"})
    assert sorted((r.v, r.t) for r in d.collect()) == sorted((v, total[k]) for k, _, v in rows)


@pytest.mark.parametrize("hot", [5, 10**9])
def test_packing_of_hot_and_other_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(packing, "HOT", hot)
    rng = random.Random(1)
    rows = [(rng.randrange(4) * rng.randrange(2), i, s := rng.randrange(60), s + rng.randrange(0, 9)) for i in range(300)]
    want = {}
    for key in {r[0] for r in rows}:
        ends: list[int] = []
        for _, i, s, e in sorted((r for r in rows if r[0] == key and r[2] < r[3]), key=lambda r: (r[2], r[3], r[1])):
            at = next((n for n, end in enumerate(ends) if end <= s), len(ends))
            ends[at:at + 1] = [e]
            want[i] = at + 1
    assert {r.id: r.line for r in packing.pack(spark.createDataFrame(rows, "key long, id long, start long, stop long")).collect()} == want


def test_large_tables_have_more_partitions(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "SORTED", 100)
    was, seen = session.partitions(spark), []

    def make():
        seen.append(session.partitions(spark))
        return spark.range(10)

    for rows in (1000, 100):
        stored(spark, str(tmp_path / str(rows)), "t", make, rows=lambda rows=rows: rows)
    assert seen == [10, was] and session.partitions(spark) == was


def test_passages_take_two_shuffles(spark):
    from lociq.operators import alleles as A
    from lociq.plans import sites

    steps, members = P.steps(spark, DATA), sites.members(spark, DATA)
    n, of = steps.count(), members.select("site").distinct().count()
    before = _shuffled(spark)
    assert A.passages(steps, members).count() > 0
    assert _shuffled(spark) - before <= 2 * n + members.count() + 20 * of


def test_links_meet_each_of_their_segments_once(spark):
    """Not once for each layer: the nodes of all layers come with the segment."""
    from lociq.operators import edges as E
    from lociq.plans.catalogue import _nodes, _rep

    d = E.edge_signs(E.oriented_pairs(P.links(spark, DATA)), _rep(spark, DATA), _nodes(spark, DATA))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") <= 4  # two, and the places of the segments within each
    want = QUERIES["layer_edges"](spark, DATA).select("layer", "source", "target", "n").collect()
    assert sorted(map(tuple, d.select("layer", "source", "target", "n").collect())) == sorted(map(tuple, want))
