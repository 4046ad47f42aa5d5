"""Scalar functions, sources and layer operators against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lociq.functions import alignment as C
from lociq.functions import arrays as A
from lociq.functions import names as N
from lociq.functions import scales as S
from lociq.operators import layers as Y
from lociq.operators import lookup as L
from lociq.plans.reading import columns_of
from lociq.sources import forest, gaf, gfa, tracks


def ops(cs):
    return re.findall(r":\d+|\*[a-z]{2}|\+[a-z]+|-[a-z]+", cs)


def to_cigar(cs):
    out = []
    for o in ops(cs):
        k, n = {":": "=", "*": "X", "+": "I", "-": "D"}[o[0]], int(o[1:]) if o[0] == ":" else 1 if o[0] == "*" else len(o) - 1
        if n and out and out[-1][1] == k:
            out[-1][0] += n
        elif n:
            out.append([n, k])
    return "".join(f"{n}{k}" for n, k in out) or None


def sliced(cs, lo, hi, reverse):
    at, out = 0, []
    comp = str.maketrans("acgtn", "tgcan")
    for o in ops(cs):
        n = int(o[1:]) if o[0] == ":" else 1 if o[0] == "*" else len(o) - 1
        a, b = max(at, lo), min(at + n, hi)
        if o[0] == ":" and a < b:
            out.append(f":{b - a}")
        elif o[0] == "-" and a < b:
            out.append("-" + o[1:][a - at : b - at])
        elif o[0] in "*+" and lo <= at < hi:
            out.append(o)
        at += 0 if o[0] == "+" else n
    if reverse:
        turn = lambda o: o if o[0] == ":" else o[0] + o[1:].translate(comp) if o[0] == "*" else o[0] + o[1:].translate(comp)[::-1]
        out = [turn(o) for o in reversed(out)]
    return "".join(out)


def test_difference_strings(spark):
    rng, rows = random.Random(2), []
    for i in range(120):
        cs = "".join(rng.choice([f":{rng.randrange(9)}", "*ag", "*tc", "+" + "acg"[: rng.randrange(1, 4)], "-" + "tgca"[: rng.randrange(1, 5)]]) for _ in range(rng.randrange(8)))
        rows.append((i, cs, rng.randrange(6), rng.randrange(4, 20), rng.random() < 0.5))
    rows.append((999, None, 0, 5, False))
    d = spark.createDataFrame(rows, "i int, cs string, lo int, hi int, rev boolean")
    cs = F.col("cs")
    got = d.select("*", C.cs_to_cigar(cs).alias("cigar"), C.cs_slice(cs, F.col("lo"), F.col("hi"), F.col("rev")).alias("cut"), C.cs_has_difference(cs).alias("dif"), C.cigar_totals(C.cs_to_cigar(cs)).alias("t")).collect()
    for r in got:
        if r["cs"] is None:
            assert r["cigar"] is None and r["cut"] is None
            continue
        assert r["cigar"] == to_cigar(r["cs"])
        assert r["cut"] == sliced(r["cs"], r["lo"], r["hi"], r["rev"])
        assert r["dif"] == bool(re.search("[*+-]", r["cs"]))
        if r["cigar"]:
            assert r["t"]["inserted"] == sum(len(o) - 1 for o in ops(r["cs"]) if o[0] == "+")


def test_names(spark):
    rows = [("HG1#1#chr1[3-4]",), ("plain",), ("a.b",), ("a#b.c#d",), ("s#x#c",), ("",)]
    g = N.parse_group(F.col("n"))
    got = [(r["g"]["sample"], r["g"]["haplotype"], r["g"]["contig"], r["k"]) for r in spark.createDataFrame(rows, "n string").select(g.alias("g"), N.haplotype_key(F.col("n")).alias("k")).collect()]
    assert got == [("HG1", "HG1#1", "HG1#1#chr1", "HG1#1"), ("plain", "plain", "plain", "plain"), ("a", "a", "a.b", "a.b"), ("a", "a#b", "a#b.c#d", "a"), ("s", "s#x", "s#x#c", "s"), ("", "", "", "")]
    paths = spark.createDataFrame([(">1<22>3",), ("1+,22-",), ("",)], "p string").select(N.path_tokens(F.col("p")).alias("t")).collect()
    assert [[tuple(x) for x in r["t"]] for r in paths] == [[(1, 1), (22, 0), (3, 1)], [(1, 1), (22, 0)], []]
    assert spark.range(1).select(C.reverse_complement(F.lit("ACGTNacgtnX"))).first()[0] == "XnacgtNACGT"


def test_selections():
    assert A.parse_ranges("0-23,24-33,7") == [(0, 23), (24, 33), (7, 7)]
    assert [A.parse_ranges(x) for x in ("", "a-b", "5-3", "1-", ",".join(["1"] * 5000))] == [None] * 5
    words, exact = A.selection_mask([(0, 1), (63, 64)], 2, 100)
    assert (words, exact) == ([3 - (1 << 63), 1], True)
    assert A.selection_mask([(64, 64)], 1, 100) == ([1], False)


def test_scales(spark):
    assert [S.parse_bp(x) for x in ("12.3Mb", "800 kb", "1,234", "7", "x", "")] == [12_300_000, 800_000, 1234, 7, None, None]
    cells = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y")).withColumn("h", S.hilbert(F.col("x"), F.col("y"), 4)).collect()
    at = {r["h"]: (r["x"], r["y"]) for r in cells}
    assert sorted(at) == list(range(256))
    assert all(abs(at[i][0] - at[i + 1][0]) + abs(at[i][1] - at[i + 1][1]) == 1 for i in range(255))


def test_layers(spark):
    assert Y.targets(100, 10) == [5, 10, 20, 40, 100][-len(Y.targets(100, 10)) :]
    rng = random.Random(1)
    parent, weight = {0: None}, {}
    for i in range(1, 400):
        parent[i] = rng.randrange(max(0, i - 30), i)
    kids = {i: [j for j in parent if parent[j] == i] for i in parent}
    for i in sorted(parent, reverse=True):
        weight[i] = max(1, sum(weight[j] for j in kids[i]))
    rows = [(i, weight[i], None if parent[i] is None else weight[parent[i]]) for i in parent]
    tree = spark.createDataFrame(rows, "node int, weight long, parent_weight long")
    count = lambda t: sum(w <= t and (p is None or t < p) for _, w, p in rows)
    aims = Y.targets(count(1), 5)
    theta = Y.thresholds(tree, aims)
    assert theta[-1] == 1 and all(a > b for a, b in zip(theta, theta[1:], strict=False))
    want = []
    for a in aims[:-1]:
        fit = [u for u in range(2, max(weight.values()) + 1) if count(u) >= a and (not want or u < want[-1])]
        want += fit[-1:]
    assert theta == [*want, 1]
    lives = {r["node"]: (r["birth"], r["death"]) for r in Y.lives(tree, theta).collect()}
    for i, w, p in rows:
        alive = [k for k, t in enumerate(theta) if w <= t and (p is None or t < p)]
        assert lives[i] == ((min(alive), None if w == 1 and max(alive) == len(theta) - 1 else max(alive) + 1) if alive else (None, lives[i][1]))
    f = Y.zoom_factors([1.0, 1.0, 1.2, 9.0], [10, 20, 40, 80])
    assert f[:2] == [1.0, 1.0] and f[2] == round(max(1.2, math.sqrt(2)), 6) and f[3] <= 4 * f[2] + 1e-6
    assert Y.choose_layer(1.1, f, 3) == 1 and Y.choose_layer(99, f, 2) == 2


def test_nearest_and_capped(spark):
    rng = random.Random(9)
    pts = [(i, rng.random(), rng.random() ** 4) for i in range(150)]
    d = spark.createDataFrame(pts, "id int, x double, y double")
    got = {r["id"]: r["dist"] for r in L.kth_distance(d, 5).collect()}
    assert got == {i: sorted(max(abs(x - a), abs(y - b)) for j, a, b in pts if j != i)[4] for i, x, y in pts}
    assert L.kth_distance(d.limit(3), 5).collect() == []
    top = L.capped(d.select("id"), 10, "id").collect()
    assert [r["id"] for r in top] == list(range(10)) and {r["truncated"] for r in top} == {1}
    assert {r["truncated"] for r in L.capped(d.select("id"), 150, "id").collect()} == {0}


def test_text_sources(spark, tmp_path):
    (tmp_path / "g.gfa").write_text("H\tVN:Z:1.0\nS\t1\tACGT\nS\t2\tA\tLN:i:1\nS\tx\tA\nS\t3\nL\t1\t+\t2\t-\t0M\nL\t1\t+\nP\tp1\t1+,2-\t*\nP\tshort\nW\ts\t0\tc\t0\t5\t>1<2\nW\ts\t0\n")
    p = str(tmp_path / "g.gfa")
    assert sorted(map(tuple, gfa.segments(spark, p).collect())) == [(1, 4, "ACGT"), (2, 1, "A")]
    assert [tuple(r) for r in gfa.links(spark, p).collect()] == [(1, 1, 2, 0, 1, 1, "0M")]
    assert sorted(map(tuple, gfa.steps(spark, p).collect())) == [("p1", 1, 1, 1), ("p1", 2, 2, 0), ("s#0#c", 1, 1, 1), ("s#0#c", 2, 2, 0)]
    line = "r1\t5\t0\t5\t+\t>1>9<2\t5\t1\t5\t4\t4\t60\ttp:A:P\tbq:Z:II\tcs:Z::4"
    (tmp_path / "r.gaf").write_text(f"@hd\n{line}\nshort\tline\n" + line.replace("r1", "r2").replace("\t1\t5\t4", "\t*\t*\t4") + "\n")
    a = gaf.alignments(spark, str(tmp_path / "r.gaf"))
    assert a.count() == 2
    steps = sorted(tuple(r) for r in gaf.read_steps(a, gfa.segments(spark, p)).collect())
    assert steps == [("r1", 1, 1, 1, 4, 1, 0, 1, 4), ("r1", 2, 9, 1, 0, 0, 4, 4, 4), ("r1", 3, 2, 0, 1, 1, 4, 4, 5)]
    assert a.select(gaf.tag("cs").alias("cs"), gaf.without_tags("bq").alias("t")).first() == (":4", ["tp:A:P", "cs:Z::4"])
    (tmp_path / "b.bed").write_text("# c\nchr1\t3\t9\nchr1\t9\t12\tlow\n\n")
    assert [tuple(r) for r in tracks.bed(spark, str(tmp_path / "b.bed")).orderBy("start").collect()] == [("chr1", 3, 9, "region"), ("chr1", 9, 12, "low")]
    (tmp_path / "t.pvst").write_text("H\th\th\th\nD\t0\t.\t1,2\nF\t1\t>3<7\t.\nF\t2\t>8>9\t3\nF\t3\t<4>5\t.\n")
    got = sorted(tuple(r)[1:] for r in forest.pvst(spark, str(tmp_path / "t.pvst")).collect())
    assert got == [(0, None, None, None, None, None), (1, 0, 3, 1, 7, -1), (2, 0, 8, 1, 9, 1), (3, 2, 4, -1, 5, 1)]


def test_columns():
    items = [(1, 0, 10, {1, 2}), (2, 3, 9, {3, 4}), (3, 12, 20, {1, 2, 3}), (4, 14, 16, {1, 2})]
    assert columns_of(items) == [0, 0, 1, 2]


@pytest.mark.parametrize("n", [2000])
def test_a_long_path_is_one_component(spark, n):
    from lociq.operators.components import connected_components

    e = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {tuple(r) for r in connected_components(e).collect()} == {(i, 0) for i in range(n + 1)}
