"""Groups of copies: no link is lost, whatever their size, and work does not follow their squares."""

import random

import numpy as np
import pytest

from lociq.llm import near


def family(rng, n, size=40, most=12, words=200):
    """Copies of one base with up to `most` words replaced, the base itself among them only by chance."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(most)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(words)}"
        out.append(" ".join(t[: len(t) - rng.randrange(3)]))
    return out


def brute(texts, k, num, den):
    sets = []
    for t in texts:
        w = t.split()
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)))
    root, by = list(range(len(sets))), {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in enumerate(sets):
        counts = {}
        for f in s:
            for j in by.setdefault(f, []):
                counts[j] = counts.get(j, 0) + 1
            by[f].append(i)
        for j, c in counts.items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("seed", range(12))
def test_settle_joins_what_links_join(seed):
    rng = random.Random(seed)
    num, den, k = [(90, 100, 3), (80, 100, 5), (50, 100, 2)][seed % 3]
    texts = [t for _ in range(3) for t in family(rng, 40, size=rng.choice([12, 40, 80]), most=rng.choice([3, 8, 20]), words=rng.choice([2, 9, 500]))]
    words = near.WordIds()
    sets = [near.shingle_set(words.of(t.encode().split()), k) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in near.settle(sets, num, den):
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
        inter = len(np.intersect1d(sets[i], sets[j]))
        assert den * inter >= num * (len(sets[i]) + len(sets[j]) - inter)
    assert [find(i) for i in range(len(sets))] == brute(texts, k, num, den)


def test_large_groups_lose_no_link(spark, monkeypatch):
    """2,000 near copies of which most are not linked, and 2,000 exact copies; rounds are forced by small shares."""
    rng = random.Random(7)
    texts = family(rng, 2000, most=14) + ["one two three four five six seven eight nine ten " * 3] * 2000 + family(rng, 200, most=3)
    monkeypatch.setattr(near, "SHARE", 64)
    rounds = []
    real = near._round
    monkeypatch.setattr(near, "_round", lambda m, *a: (rounds.append(m.count()), real(m, *a))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in near.jaccard_components(docs, 3, 90, 100).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 3, 90, 100)
    assert len(rounds) > 1 and sum(rounds) < 40 * len(texts)  # far from the two million pairs of the family


def test_a_family_is_not_once_for_each_signature(spark, monkeypatch):
    """Groups of one family that are too large for a task are one group, so rows do not grow with its signatures."""
    rng = random.Random(11)
    texts = family(rng, 1500, most=14)
    monkeypatch.setattr(near, "SHARE", 64)
    held = []
    real = near._round
    monkeypatch.setattr(near, "_round", lambda m, *a: (held.append(m.groupBy("gid").count().where("count > 64").groupBy().sum("count").first()[0] or 0), real(m, *a))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in near.jaccard_components(docs, 5, 80, 100).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 5, 80, 100)
    assert held[0] <= 2 * len(texts) // 3, held  # 1,232 when every signature had its own


def test_keys_allow_for_the_size_of_a_partner():
    """A set of the group that is too small to be linked does not make others show more of their features."""
    most, own = np.arange(1000, dtype=np.uint64), np.arange(5000, 5100, dtype=np.uint64)
    y = np.concatenate((most[:200], own))
    assert len(near._keys(y, np.arange(len(y)) < 200, most, 1, 90, 100)) < 100


def test_texts_of_no_candidate_are_left_out(spark):
    rows = spark.range(5000).selectExpr("id as key", "id as v")
    got = {r["v"] for r in near.maybe_in(rows, spark.range(0, 5000, 50).selectExpr("id as key")).collect()}
    assert set(range(0, 5000, 50)) <= got and len(got) < 150


def test_a_written_table_leaves_no_shuffle_files(spark):
    from pathlib import Path

    from lociq.session import materialize

    def left() -> set[Path]:
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {p for d in dirs for p in Path(d).glob("*/shuffle_*")}

    before = left()
    d = materialize(spark.range(1000).selectExpr("id", "id % 7 as k").repartition("k"), "dealt")
    assert not left() - before and d.count() == 1000
