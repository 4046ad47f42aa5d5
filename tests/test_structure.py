"""Signed components, pivots and packed rows against the plain procedures."""

import random
from collections import deque

import numpy as np
import pytest

from lociq.operators import packing, pivots, signed


def plain_signed(votes):
    """Strongest first; (node -> (least node of the group, side), kept)."""
    group = {}
    for a, b, *_ in votes:
        for n in (a, b):
            group.setdefault(n, ({n: 0}))
    kept = {}
    for a, b, same, _ in sorted(votes, key=lambda v: (-v[3], v[0], v[1])):
        if group[a] is not group[b]:
            turn = group[a][a] ^ group[b][b] ^ (1 - same)
            for n, s in group[b].items():
                group[a][n] = s ^ turn
            for n in list(group[b]):
                group[n] = group[a]
        kept[a, b] = int((group[a][a] == group[a][b]) == (same == 1))
    return {n: (min(g), g[n] ^ g[min(g)]) for n, g in group.items()}, kept


@pytest.mark.parametrize("seed", [1, 2])
def test_sides_equal_a_signed_union_find(spark, seed):
    rng = random.Random(seed)
    votes = {(a, b): (a, b, rng.randint(0, 1), rng.randint(1, 4)) for a, b in (sorted(rng.sample(range(-5, 30), 2)) for _ in range(50))}
    d = spark.createDataFrame(list(votes.values()), "a long, b long, same long, strength long")
    node, kept = signed.settle(d)
    want, keeps = plain_signed(list(votes.values()))
    assert {r.node: (r.component, r.side) for r in node.collect()} == want
    assert {(r.a, r.b): r.kept for r in kept.collect()} == keeps and 0 in keeps.values()


def test_relations_that_clash_are_reported(spark):
    d = spark.createDataFrame([(1, 2, 1), (2, 3, 0), (1, 3, 1), (7, 8, 0), (8, 9, 0)], "a long, b long, same long")
    assert sorted((r.node, r.component, r.side, r.conflict) for r in signed.sides(d).collect()) == [(1, 1, None, 1), (2, 1, None, 1), (3, 1, None, 1), (7, 7, 0, 0), (8, 7, 1, 0), (9, 7, 0, 0)]


def plain_hops(near, seed):
    out, todo = {seed: 0}, deque([seed])
    while todo:
        u = todo.popleft()
        for v in near[u]:
            if v not in out:
                out[v] = out[u] + 1
                todo.append(v)
    return out


def test_pivots_and_plane(spark):
    rng = random.Random(3)
    pairs = {(i, i + 1) for i in range(29)} | {(a, b) for a, b in (sorted(rng.sample(range(30), 2)) for _ in range(6))} | {(100, 101)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    got = pivots.pivots(spark.createDataFrame(sorted(pairs), "a long, b long"), 5)
    rows = {(r.node, r.pivot): r.hop for r in got.collect()}
    seed, closest = 0, dict.fromkeys(near)
    for i in range(5):
        d = plain_hops(near, seed)
        assert {n: h for (n, p), h in rows.items() if p == i} == d
        closest = {n: min((x for x in (c, d.get(n)) if x is not None), default=None) for n, c in closest.items()}
        seed = min(closest, key=lambda n: (closest[n] is not None, -(closest[n] or 0), n))
    assert (101, 1) in rows and (0, 1) not in rows  # the second pivot lies where the first does not reach
    main = got.where("node < 100 and pivot <> 1")
    nodes = range(30)
    s = np.array([[rows[n, p] ** 2 for p in (0, 2, 3, 4)] for n in nodes], float)
    c = -0.5 * (s - s.mean(1, keepdims=True) - s.mean(0) + s.mean())
    dense = c @ np.linalg.svd(c)[2][:2].T
    xy = {r.node: (r.x, r.y) for r in pivots.plane(main).collect()}
    for axis in range(2):
        mine = np.array([xy[n][axis] for n in nodes])
        assert min(abs(mine - dense[:, axis]).max(), abs(mine + dense[:, axis]).max()) < 1e-6


def test_packed_rows_do_not_overlap_and_are_as_few_as_can_be(spark):
    rng = random.Random(4)
    rows = [(k, i, s, s + rng.randint(0, 9)) for k in range(6) for i, s in enumerate(rng.randint(0, 30 + 60 * k) for _ in range(60))]
    got = {(r.key, r.id): r.line for r in packing.pack(spark.createDataFrame(rows, "key long, id long, start long, stop long")).collect()}
    for k in range(6):
        mine = [(s, e, got[k, i]) for x, i, s, e in rows if x == k and s < e]
        assert len(mine) == sum(1 for key, _ in got if key == k)
        assert all(a[2] != b[2] or a[1] <= b[0] or b[1] <= a[0] for i, a in enumerate(mine) for b in mine[:i])
        assert max(x[2] for x in mine) == max(sum(s <= p < e for s, e, _ in mine) for p in range(500))


def test_hops_do_not_send_the_links_again(spark):
    """On a dense graph with a tail and a second component, distances are those of the plain procedure, and what is shuffled
    stays in proportion to the links, not to links times hops times pivots."""
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(400), 2))) for _ in range(12000)} | {(399 + i, 400 + i) for i in range(4)} | {(900, 901), (901, 902)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    given = spark.createDataFrame(sorted(pairs), "a long, b long").repartition(2).cache()
    sizes = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}  # joins run as they do on large tables
    was = {k: spark.conf.get(k) for k in sizes}
    given.count()
    tables = {t.name for t in spark.catalog.listTables()}
    before = _shuffled(spark)
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        got = pivots.pivots(given, 5)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert _shuffled(spark) - before < 3 * 2 * len(pairs)
    assert {t.name for t in spark.catalog.listTables()} == tables
    rows = {(r.node, r.pivot): r.hop for r in got.collect()}
    seed, closest = 0, dict.fromkeys(near)
    for i in range(5):
        d = plain_hops(near, seed)
        assert {n: h for (n, p), h in rows.items() if p == i} == d
        closest = {n: min((x for x in (c, d.get(n)) if x is not None), default=None) for n, c in closest.items()}
        seed = min(closest, key=lambda n: (closest[n] is not None, -(closest[n] or 0), n))
    assert len({p for _, p in rows}) == 5 and len(rows) > 1200
    given.unpersist()


def _shuffled(spark) -> int:
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_no_links_no_pivots(spark):
    got = pivots.pivots(spark.createDataFrame([], "a long, b long"), 5)
    assert got.columns == ["node", "pivot", "hop"] and got.isEmpty() and pivots.plane(got).isEmpty()


def test_plane_holds_nodes_that_every_pivot_reaches(spark):
    rows = [(n, p, abs(3 * p - n)) for n in range(8) for p in range(3)]
    some = [(50, 0, 1), (51, 1, 2), (51, 2, 2)]
    schema = "node long, pivot long, hop long"
    got, want = (sorted(map(tuple, pivots.plane(spark.createDataFrame(x, schema)).collect())) for x in (rows + some, rows))
    assert [r[0] for r in want] == list(range(8)) and [r[0] for r in got] == [r[0] for r in want]
    assert np.allclose(got, want)
