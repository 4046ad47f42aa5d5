"""Name search by index finds what a scan finds, and reads few lists."""

import random

import pytest

from lociq.operators import names_index as N


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(1)
    nodes = sorted({"".join(rng.choice("abAB#1Ü") for _ in range(rng.randint(0, 9))) for _ in range(4000)} | {f"n{i}" for i in range(200)} | {"Straße", "x*y", "x[y", "%_", "a%b"})
    made = spark.createDataFrame([(n, layer) for i, n in enumerate(nodes) for layer in (i % 3, 3)], "node string, layer long")
    base = tmp_path_factory.mktemp("index")
    named = N.names(made)
    named.repartitionByRange(8, "node").sortWithinPartitions("node").write.parquet(f"{base}/names")
    named = spark.read.parquet(f"{base}/names")
    lists = N.postings(named)
    lists.repartitionByRange(8, "bucket", "gram", "node").sortWithinPartitions("bucket", "gram", "node").write.partitionBy("bucket").parquet(f"{base}/lists")
    lists = spark.read.parquet(f"{base}/lists")
    return nodes, {n: i % 3 for i, n in enumerate(nodes)}, named, lists, N.frequencies(lists)


@pytest.mark.parametrize("text", ["n17", "n1", "bAb", "abab", "ABAB1", "ü#", "STRASSE", "straße", "x*y", "*", "[", "%", "_", "zzzz", "", "b", "ab#ab#ab#", "n199"])
def test_search_equals_scan(index, text):
    nodes, layer, *tables = index
    same, begin, hold = [n for n in nodes if n == text], [n for n in nodes if n.startswith(text)], [n for n in nodes if text.lower() in n.lower()]
    stage, found = (0, same) if same else (1, begin) if begin and not set(text) & set("*?[]") else (2, hold)
    got = [tuple(r) for r in N.search(*tables, text).collect()]
    assert got == [(n, layer[n], stage) for n in sorted(found)[:50]]


def _scans(plan):
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            out.append(p)
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def test_a_substring_reads_few_files(index):
    _, _, named, lists, sizes = index
    d = N.containing(named, lists, sizes, "ab1a")
    d.collect()
    read = sum(s.metrics().apply("numFiles").value() for s in _scans(d._jdf.queryExecution().executedPlan()))
    assert 0 < read <= 8 * N.MOST_LISTS < len(lists.inputFiles())


def test_a_search_reads_the_rarest_lists(index):
    _, _, named, lists, sizes = index
    known = {r.gram: r.n for r in sizes.collect()}
    text = max(("abab1#a", "babab1", "aabb##1"), key=lambda t: sum(g in known for g in N.grams_of(t)))
    plan = N.containing(named, lists, sizes, text)._jdf.queryExecution().optimizedPlan().toString()
    rare = sorted(N.grams_of(text), key=lambda g: (known.get(g, 0), g))[: N.MOST_LISTS]
    assert all(g in plan for g in rare) or not all(g in known for g in N.grams_of(text))
