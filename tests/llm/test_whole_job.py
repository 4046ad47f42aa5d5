"""Places where an operator once did less than the whole job."""

import heapq
import random
import time

import pytest
from pyspark.sql import functions as F

from lociq.llm import mixing, quality, substring


def earliest_deadline_first(shares):
    """The source of every slot of one period."""
    names, period = sorted(shares), sum(shares.values())
    wait = [(0, i, 0) for i in range(len(names))]
    ready, out = [], []
    for t in range(period):
        while wait and wait[0][0] <= t:
            _, i, j = heapq.heappop(wait)
            heapq.heappush(ready, (-(-(j + 1) * period // shares[names[i]]), i, j))
        _, i, j = heapq.heappop(ready)
        out.append((names[i], j))
        if j + 1 < shares[names[i]]:
            heapq.heappush(wait, ((j + 1) * period // shares[names[i]], i, j + 1))
    return out


def test_mixing_schedules_any_number_of_sources(spark):
    shares = {f"s{i * 7919 % 2600}": 1 + i * i % 5 + 20 * (i % 400 == 0) for i in range(2600)}
    docs = spark.createDataFrame([(i, f"s{i % 2600}") for i in range(5200)] + [(9000, "none"), (9001, None)], "doc_id long, source string")
    given = spark.createDataFrame(list(shares.items()), "source string, share int")
    want = {x: t for t, x in enumerate(earliest_deadline_first(shares))}
    plan = mixing.schedule(given).collect()
    assert len(plan) == len(want) and {(r["source"], r["j"]): r["offset"] for r in plan} == want
    got = mixing.mix(docs, block=1, shares=given).collect()
    assert len(got) == 5202  # documents of sources without a share stay, unplaced
    period = sum(shares.values())
    for r in got:
        if r["source"] in shares:
            a = shares[r["source"]]
            assert r["mix_slot"] == r["mix_block"] // a * period + want[r["source"], r["mix_block"] % a]
        else:
            assert r["mix_slot"] is None
    assert mixing.mix(docs, size=F.lit(1)).where("mix_slot is not null").count() == 5202


def test_pipeline_returns_the_mix(spark, monkeypatch):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(9 + i % 4)), "en", "abc"[i % 7 % 3], 0) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: docs.repartition(5))
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])  # the others drop such texts
    want = {r["doc_id"]: (r["source"], r["mix_slot"], r["mix_rank"]) for r in mixing.mix(docs).collect()}
    got = corpus_pipeline.run(spark, "").orderBy("mix_slot", "mix_rank").collect()
    assert {r["doc_id"]: (r["source"], r["mix_slot"], r["mix_rank"]) for r in got} == want and len(got) == 400
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in got)
    assert len({r["source"] for r in got[:120]}) == 3


def halves(spark):
    """Forty documents and forty that repeat passages of them."""
    rng = random.Random(2)
    first = [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(40))) for i in range(40)]
    return [spark.createDataFrame(x, "doc_id long, text string") for x in (first, [(100 + i, f"n{i} " + t[: len(t) // 2]) for i, t in first])]


@pytest.mark.parametrize("seed", [0, 3])
def test_substring_index_outlives_partitions_and_seeds(spark, monkeypatch, seed):
    first, then = halves(spark)
    want = {r["doc_id"]: r["n_removed"] for r in substring.dedup(first.union(then), size=5).collect()}
    assert sum(want.values()) > 500
    with monkeypatch.context() as m:
        if seed:  # the first batch has retried
            bad = iter([1] * seed)
            m.setattr(substring, "_mismatches", lambda *a: next(bad, 0))
        path = substring.index_location(spark)
        got = {r["doc_id"]: r["n_removed"] for r in substring.dedup(first, size=5, index_path=path).collect()}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        got |= {r["doc_id"]: r["n_removed"] for r in substring.dedup(then, size=5, index=spark.read.parquet(path)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want


def test_substring_verifies_the_batch_beside_an_index(spark, monkeypatch):
    first, then = halves(spark)
    path = substring.index_location(spark)
    substring.dedup(first, size=5, index_path=path)
    index = spark.read.parquet(path)
    # An id that history used too, and a passage that repeats within the batch.
    more = then.union(spark.createDataFrame([(1, "a b c d e f g h"), (2, "z a b c d e f g")], then.schema))
    got = {r["doc_id"]: r["n_removed"] for r in substring.dedup(more, size=5, index=index).collect()}
    assert (got[1], got[2]) == (0, 7)
    monkeypatch.setattr(substring, "_mismatches", lambda *a: 1)
    with pytest.raises(ArithmeticError):
        substring.dedup(more, size=5, index=index)


def test_verdicts_can_be_filtered(spark):
    """A filter stays above what the verdict is computed from: the plan grows by it, and does not multiply."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    every, kept = quality.assess(docs), quality.assess(docs).where("kept").select("doc_id")
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (every, kept)]
    assert [p.count("xxhash64") for p in plans] == [2, 2]
    begun = time.time()
    ids = {r.doc_id for r in every.collect() if r.kept}
    first = time.time() - begun
    begun = time.time()
    assert {r.doc_id for r in kept.collect()} == ids and ids
    assert time.time() - begun < 2 * first + 5
