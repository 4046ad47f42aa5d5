"""Running sums: keys with few rows by windows, others by ranges, with the same figures and one shuffle for the former."""

from __future__ import annotations

import pytest

from lociq.operators import stretches


@pytest.mark.parametrize("hot", [10, 400, 10**9])
def test_hot_and_other_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(stretches, "HOT", hot)
    rows = [(None if i % 3 == 0 else f"k{i % 40 % 7}", i * 7919 % 1000, i) for i in range(1000)]
    d = stretches.along(spark.createDataFrame(rows, "k string, i long, v long"), ["k"], ["i"], {"s": "v", "n": "1"}, {"was": "v"})
    want, at = [], {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        s, n, was = at.get(k, (0, 0, None))
        at[k] = s + v, n + 1, v
        want.append((k, i, v, s + v, n + 1, was))
    assert sorted(map(tuple, d.collect()), key=lambda r: r[1]) == want


def test_keys_without_many_rows_are_not_written(spark, monkeypatch):
    wrote = []
    monkeypatch.setattr(stretches, "materialize", lambda *a: wrote.append(a))
    d = stretches.along(spark.range(1000).selectExpr("id % 50 as k", "id as i"), ["k"], ["i"], {"n": "1"})
    assert not wrote and d.where("n = 20").count() == 50
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_gains_meet_the_nodes_twice(spark):
    """Sizes of communities come with the nodes: rows of gains are not shuffled again by either community."""
    from lociq.operators import communities

    nodes = spark.sql("select 1L as g, id as node, id as comm, 2L as deg, 20L as total, 2L as size from range(10)")
    links = spark.range(10).selectExpr("1L as g", "id as u", "explode(array((id + 9) % 10, (id + 1) % 10)) as v", "1L as w")
    d = communities._gains(nodes, links)
    assert {(r["node"], r["to"], r["gain"]) for r in d.collect()} == {(i, (i + s) % 10, 20 - 2 * 2) for i in range(10) for s in (1, 9)}
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 5  # two of them in the side of own links too
