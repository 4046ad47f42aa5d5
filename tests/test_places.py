"""Nearest places against all pairs: dense clusters, hot spots, ties, missing places, empty sides."""

from __future__ import annotations

import math
import random

import pytest

from lociq.operators import lookup, places

P, M = "id long, x double, y double", "mark long, x double, y double"


def scattered(n, seed):
    """Most places in a few tight clusters, some far off, repeats on a lattice."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            c = rng.choice([(0.1, 0.1), (0.5, 0.9), (1e-7, 3e-7)])
            out.append((i, c[0] + rng.gauss(0, 1e-5), c[1] + rng.gauss(0, 1e-5)))
        elif kind < 0.9:
            out.append((i, rng.randrange(5) / 4, rng.randrange(5) / 4))
        else:
            out.append((i, rng.uniform(-500, 500), rng.uniform(-500, 500)))
    return out


@pytest.mark.parametrize(("metric", "k"), [("straight", 1), ("straight", 4), ("square", 6)])
def test_nearest_equals_all_pairs(spark, metric, k):
    points, marks = scattered(250, 1), scattered(400, 2)
    size = math.hypot if metric == "straight" else max
    got = {}
    for r in places.nearest(spark.createDataFrame(points, P), spark.createDataFrame(marks, M), k, metric).collect():
        got.setdefault((r["x"], r["y"]), []).append((r["rank"], r["mark"], r["dist"]))
    assert set(got) == {(x, y) for _, x, y in points}
    for (x, y), found in got.items():
        want = sorted((size(abs(mx - x), abs(my - y)), m) for m, mx, my in marks)[:k]
        assert [(m, pytest.approx(d, abs=1e-12)) for _, m, d in sorted(found)] == [(m, d) for d, m in want]


def test_hot_spot_and_missing_places(spark):
    marks = [(i, 0.25, 0.25) for i in range(500)] + [(900, 1.0, 1.0), (901, None, 1.0), (902, float("nan"), 0.0), (903, float("inf"), 0.0)]
    points = [(i, 0.25, 0.25) for i in range(300)] + [(400, 0.9, 1.0), (401, None, 0.0), (402, 0.0, float("-inf"))]
    best = places.nearest(spark.createDataFrame(points, P), spark.createDataFrame(marks, M), 3).collect()
    assert {(r["x"], r["rank"], r["mark"]) for r in best} == {(0.25, 1, 0), (0.25, 2, 1), (0.25, 3, 2), (0.9, 1, 900), (0.9, 2, 0), (0.9, 3, 1)}
    near = lookup.nearest_by(spark.createDataFrame(points, P), spark.createDataFrame(marks, M).toDF("mark", "mx", "my")).collect()
    assert len(near) == len(points) and {(r["id"], r["mark"]) for r in near if r["id"] >= 400} == {(400, 900), (401, None), (402, None)}
    far = {r["id"]: r["dist"] for r in lookup.kth_distance(spark.createDataFrame(points, P), 299).collect()}
    assert far[0] == 0.0 and far[400] == 0.75 and len(far) == 301


def test_nothing_to_find(spark):
    some, none = spark.createDataFrame([(1, 0.0, 0.0)], P), spark.createDataFrame([], M)
    assert [(r["id"], r["mark"], r["dist"]) for r in lookup.nearest_by(some, none.toDF("mark", "mx", "my")).collect()] == [(1, None, None)]
    assert places.nearest(some.where("false"), none).collect() == [] and lookup.kth_distance(some, 1).collect() == []
