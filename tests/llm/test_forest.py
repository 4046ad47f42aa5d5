"""op6's routed forest: answers against brute force in far and hostile data, trees that a bound skips, visits that follow the table."""

from __future__ import annotations

import math
import random

import pytest

from lociq.llm import mtree


def brute(rows, every, k):
    valid = [(i, mtree.integers(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(q, tuple(v)) for q, v in valid if q % every == 0}:
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=False)))), j) for j, w in valid if j != q)[:k]
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(mtree, "TREE", 40)
    monkeypatch.setattr(mtree, "PAGE", 8)
    monkeypatch.setattr(mtree, "ROUND", 2)
    monkeypatch.setattr(mtree, "BLOCK", 4)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


def clusters(n, seed):
    """Unit vectors around 20 directions."""
    rng = random.Random(seed)
    hubs = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(20)]
    rows = []
    for i in range(n):
        v = [x + rng.gauss(0, 0.03) for x in hubs[i % 20]]
        norm = math.sqrt(sum(x * x for x in v))
        rows.append((i, [x / norm for x in v]))
    return rows


def test_far_trees_are_skipped(spark, small):
    shares = {}
    for n in (800, 3200):
        df = frame(spark, clusters(n, 3), "double")
        got, rounds, trees = mtree.search_forest(df, every=50, k=4)
        queries, visits = n // 50, sum(r.count() for r in rounds)
        assert trees >= n // 40 and rounds[0].count() == queries
        shares[n] = visits / (queries * trees)
        assert sorted(map(tuple, got.collect())) == brute(clusters(n, 3), 50, 4)
    assert shares[800] < 0.5 and shares[3200] < 0.5 * shares[800] + 0.05  # visits of a query follow its surroundings, not the table


def test_copies_ties_and_widths(spark, small):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5]) for _ in range(rng.choice([0, 1, 3, 5]))]) for i in range(150)]
    rows += [(200 + i, [0.5, 0.25, -1.0]) for i in range(120)] + [(240, [0.5, 0.25, -1.0])] * 30 + [(260, [0.5, 0.25, -1.0]), (260, [9.0])]
    rows += [(400, None), (None, [1.0]), (420, [float("inf")]), (440, [1.0, None])]
    got, rounds, _ = mtree.search_forest(frame(spark, rows), every=20, k=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20, 4)


def test_scores_beyond_64_bits(spark, small):
    rng = random.Random(6)
    rows = [(i, [rng.choice([1.0, -1.0]) * 10.0 ** rng.choice([0, 3, 12, 200, 305]) for _ in range(3)]) for i in range(100)]
    got, _, _ = mtree.search_forest(frame(spark, rows, "double"), every=10, k=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 3)
