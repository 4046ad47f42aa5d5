"""Exact top-k by inner product: best-first search in a routed forest of M-trees.

Vectors are turned into integers; one more coordinate, sqrt(M^2 - |x|^2) with one M for the table, makes the Euclidean
distance to a query (with 0 there) fall as the inner product rises, so a metric tree answers it. The forest has two kinds
of pages. Its root page holds at most ROUTES routing objects with their covering radii; every object belongs to the
nearest one. The objects of a routing object are sorted by their distance to it and cut into M-trees, so the page below
holds for each tree the ring of distances to the parent that it fills; a routing object with most of the table has as many
trees, on as many tasks, as it needs. Inside a tree, paged nodes hold a routing object, a covering radius and the distance
to their parent object. The stored distances bound d(q, object) >= |d(q, parent) - d(object, parent)|, for rings and for
objects alike, so most entries are dropped before a distance is computed.

A query visits trees in the order of their least possible distance: first its nearest, then the next ROUND, then all
that its bound still admits. After each round its k-th score so far is the bound of the next, and the trees beyond are
skipped. Bounds are loosened by far more than the rounding error, so no result is lost. What is sent are the visits: a
tree once for each BLOCK queries that visit it. Where distances tell nothing apart (random directions of 64 dimensions:
over 98 % of the visits remain) an exact search has to look at everything.

Of equal vectors only the k + 1 smallest ids, with their repeats, go into the forest, so copies cost nothing.

Defined results: vectors that are null or hold null or non-finite components, and rows without id, take no part; missing
components of shorter vectors count as zero; an id is never a candidate for itself, whichever row it stands in; repeated
rows of a query are one query, rows of one id with different vectors are ranked apart; repeated candidates each count;
a score that no 64-bit integer can hold is given as the nearest one; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.llm.text import batches
from lociq.session import materialize, pick

#: Entries of a page; objects and components of a tree; queries of a block; routing objects of the root page; trees of the second round.
PAGE, TREE, CELLS, BLOCK = 64, 2048, 1 << 19, 1024
ROUTES, ROUND = 256, 8

#: Trees up to which the page of rings is broadcast: 3 MB.
RINGS = 100_000

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def integers(v: list[float]) -> list[int]:
    return [math.floor(y) if math.isfinite(y := 1024.0 * x) else int(x) * 1024 for x in v]


def _array(rows: list[list[int]]) -> np.ndarray:
    """Rows as one array, zero-padded; int64, or Python integers where inner products could leave 53 bits."""
    width = max(map(len, rows))
    top = max((max(map(abs, r), default=0) for r in rows), default=0)
    out = np.zeros((len(rows), width), np.int64 if top < 1 << 20 else object)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    n = min(x.shape[1], len(q))
    if x.dtype == object or q.dtype == object:
        exact = [sum(int(a) * int(b) for a, b in zip(r[:n], q[:n], strict=True)) for r in x]
        return np.array([max(LEAST, min(MOST, s)) for s in exact], np.int64)
    return (x[:, :n].astype(np.float64) @ q[:n].astype(np.float64)).astype(np.int64)


@dataclass(frozen=True)
class Space:
    """The metric of a table: components are divided by scale, and top is no less than any squared norm then."""

    scale: int
    top: float

    def floats(self, x: np.ndarray) -> np.ndarray:
        if x.dtype == object:
            return np.array([[int(a) / self.scale for a in r] for r in x], np.float64).reshape(x.shape)
        return x / self.scale

    def points(self, x: np.ndarray) -> np.ndarray:
        f = self.floats(x)
        return np.column_stack((f, np.sqrt(np.maximum(0.0, self.top - (f * f).sum(axis=1)))))

    def limit(self, qq: float, score: int | None) -> float:
        """No object at this score or above is farther from a query of squared norm qq."""
        if score is None or score <= LEAST:
            return math.inf
        slack = 1e-6 * (math.sqrt(self.top) + math.sqrt(qq) + 1e-3)
        return math.sqrt(max(0.0, qq + self.top - 2.0 * (score / (self.scale * self.scale)))) + slack


@dataclass
class MTree:
    """vectors: distinct objects; ids: of each, ascending. Nodes are (is leaf, objects, radii, distances to parent, children)."""

    vectors: np.ndarray
    ids: list[list[int]]
    space: Space
    nodes: list[tuple] = field(default_factory=list)
    root: int = 0

    @staticmethod
    def build(rows: list[tuple[int, int, list[int]]], space: Space) -> MTree:
        """rows: (id, how often, vector)."""
        by: dict[tuple, list[int]] = {}
        for i, n, v in rows:
            while v and v[-1] == 0:
                v = v[:-1]
            by.setdefault(tuple(v), []).extend([i] * n)
        tree = MTree(_array([list(v) or [0] for v in by]), [sorted(x) for x in by.values()], space)
        tree.points = space.points(tree.vectors)
        tree.root, _ = tree._page(np.arange(len(tree.vectors)), None, np.random.default_rng(7))
        return tree

    def _far(self, a: int, others: np.ndarray) -> np.ndarray:
        d = self.points[others] - self.points[a]
        return np.sqrt((d * d).sum(axis=1))

    def _page(self, at: np.ndarray, parent: int | None, rng: np.random.Generator) -> tuple[int, float]:
        """A node over these objects: its number, and its radius around the parent object."""
        up = self._far(parent, at) if parent is not None else np.zeros(len(at))
        if len(at) <= PAGE:
            self.nodes.append((True, at, np.zeros(len(at)), up, None))
            return len(self.nodes) - 1, float(up.max(initial=0.0))
        routes = rng.choice(at, min(PAGE // 2, max(2, len(at) // (PAGE // 2))), replace=False)
        near = np.argmin(np.stack([self._far(r, at) for r in routes]), axis=0)
        if np.bincount(near).max() == len(at):
            near = np.arange(len(at)) % len(routes)
        kids = [(r, at[near == k]) for k, r in enumerate(routes) if (near == k).any()]
        made = [self._page(group, r, rng) for r, group in kids]
        objects = np.array([r for r, _ in kids])
        self.nodes.append((False, objects, np.array([x for _, x in made]), self._far(parent, objects) if parent is not None else np.zeros(len(kids)), np.array([n for n, _ in made])))
        return len(self.nodes) - 1, float(up.max(initial=0.0))

    def search(self, qid: int, q: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) but for qid: highest score, then smallest id. Scores below floor need not be among them."""
        full = self.space.floats(q[None, :])[0]
        qf = np.zeros(self.points.shape[1])
        n = min(len(q), qf.size - 1)
        qf[:n] = full[:n]
        qq = float((full * full).sum())
        rest = float((full[n:] ** 2).sum())  # components that no object of this tree has
        best: list[tuple[int, int]] = []  # heap of (score, -id)

        def within(score: int | None) -> float:
            d = self.space.limit(qq, score)
            return d if math.isinf(d) else math.sqrt(max(0.0, d * d - rest))

        limit = within(floor)
        heap: list[tuple[float, int, float | None]] = [(0.0, self.root, None)]
        while heap:
            least, node, to_parent = heapq.heappop(heap)
            if least > limit:
                break
            leaf, objects, radii, up, kids = self.nodes[node]
            if to_parent is not None and limit < math.inf:
                some = np.flatnonzero(np.abs(to_parent - up) - radii <= limit)
            else:
                some = np.arange(len(objects))
            if not len(some):
                continue
            if leaf:
                for o, s in zip(objects[some], _dot(self.vectors[objects[some]], q).tolist(), strict=True):
                    if (floor is not None and s < floor) or (len(best) == k and s < best[0][0]):
                        continue
                    for i in self.ids[o]:
                        if i == qid:
                            continue
                        if len(best) < k:
                            heapq.heappush(best, (s, -i))
                        elif (s, -i) > best[0]:
                            heapq.heapreplace(best, (s, -i))
                        else:
                            break
                if len(best) == k:
                    limit = min(limit, within(best[0][0]))
            else:
                d = self.points[objects[some]] - qf
                d = np.sqrt((d * d).sum(axis=1))
                for x, r, kid in zip(d.tolist(), radii[some].tolist(), kids[some].tolist(), strict=True):
                    if x - r <= limit:
                        heapq.heappush(heap, (max(0.0, x - r), kid, x))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


#: What takes part, as SQL over a column v of doubles.
VALID = "id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"


def _far(points: np.ndarray, v: np.ndarray, last: float) -> np.ndarray:
    """Distances of one vector, with its last coordinate, to points of any width."""
    n = min(points.shape[1] - 1, len(v))
    d = points[:, :-1].copy()
    d[:, :n] -= v[:n]
    return np.sqrt((d * d).sum(axis=1) + float((v[n:] ** 2).sum()) + (points[:, -1] - last) ** 2)


def _space(rows: DataFrame) -> Space | None:
    most = rows.agg(F.expr("max(array_max(transform(v, x -> abs(x))))").alias("m"), F.count("*").alias("n")).first()
    if not most["n"]:
        return None
    scale = 1024 * (int(most["m"] or 0.0) + 1)
    part = f"1024D * x / {float(scale)!r}D" if scale < 1 << 60 else f"x / {float(scale // 1024)!r}D"
    step = 1.0 / scale if scale < 1 << 60 else 0.0  # what rounding down can add to a component
    top = rows.agg(F.expr(f"max(aggregate(v, 0D, (a, x) -> a + pow(abs({part}) + {step!r}D, 2)))").alias("t")).first()["t"]
    return Space(scale, top * (1 + 1e-9) + 1e-12)


def _routes(rows: DataFrame, n: int, space: Space) -> np.ndarray:
    """Points of at most n routing objects, those whose ids have the smallest hashes."""
    drawn = rows.select(F.xxhash64("id").alias("h"), "id", "v").orderBy("h", "id", "v").limit(n).collect()  # at most ROUTES rows
    return space.points(_array([list(v) or [0] for v in sorted({tuple(integers(r["v"])) for r in drawn})]))


def _placed(rows: DataFrame, routes: np.ndarray, space: Space) -> DataFrame:
    """(id, n, v, route, far): each object with its nearest routing object."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("v", pa.list_(pa.float64())), ("route", pa.int32()), ("far", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for b in it:
                for i, n, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    p = space.points(_array([integers(v) or [0]]))[0]
                    d = _far(routes, p[:-1], float(p[-1]))
                    yield i, n, v, int(d.argmin()), float(d.min())

        yield from batches(out(), schema)

    return rows.select("id", "n", "v").mapInArrow(run, "id long, n long, v array<double>, route int, far double")


def _trees(placed: DataFrame, space: Space) -> DataFrame:
    """(no, route, low, high, blob): M-trees of neighbouring rings of a routing object."""
    schema = pa.schema([("no", pa.int64()), ("route", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("blob", pa.binary())])
    # Many objects may lie at one distance: their ids set them apart.
    dealt = placed.repartitionByRange("route", "far", "id").sortWithinPartitions("route", "far", "id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32

        def out() -> Iterator[tuple]:
            kept, made, width, now, low, high = [], 0, 0, None, 0.0, 0.0
            for b in it:
                for i, n, v, route, far in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    width = max(width, len(v))
                    if kept and (route != now or len(kept) == TREE or (len(kept) + 1) * width > CELLS):
                        yield base + made, now, low, high, pickle.dumps(MTree.build(kept, space))
                        kept, made, width = [], made + 1, len(v)
                    if not kept:
                        now, low = route, far
                    kept.append((i, n, integers(v)))
                    high = far
            if kept:
                yield base + made, now, low, high, pickle.dumps(MTree.build(kept, space))

        yield from batches(out(), schema, 1)

    return dealt.select("id", "n", "v", "route", "far").mapInArrow(run, "no long, route int, low double, high double, blob binary")


def _admitted(asked: DataFrame, rings: DataFrame, few: bool, routes: np.ndarray, radii: dict[int, float], space: Space) -> DataFrame:
    """(q, no, least, far) of every tree that may hold an object at floor or above, for asked(q, v, floor)."""
    schema = pa.schema([("q", pa.int64()), ("route", pa.int32()), ("far", pa.float64()), ("most", pa.float64())])
    reach = np.array([radii.get(r, -math.inf) for r in range(len(routes))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for b in it:
                for q, v, floor in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    f = space.floats(_array([integers(v) or [0]]))[0]
                    most, d = space.limit(float((f * f).sum()), floor), _far(routes, f, 0.0)
                    for r in np.flatnonzero((d - reach <= most) & (reach >= 0)).tolist():
                        yield q, r, float(d[r]), most

        yield from batches(out(), schema)

    pairs = asked.select("q", "v", "floor").mapInArrow(run, "q long, route int, far double, most double")
    least = F.greatest(F.lit(0.0), F.col("far") - F.col("high"), F.col("low") - F.col("far"))
    page = F.broadcast(rings) if few else rings
    return pairs.join(page, "route").withColumn("least", least).where("least <= most").select("q", "no", "least", "far")


def _visit(visits: DataFrame, asked: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """(q, vec_id, score): the best k of each visit(q, no) at the query's floor or above."""
    blocks = visits.groupBy("no").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    left = trees.select("no", "blob").join(blocks, "no").select("no", "blob", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    right = visits.join(blocks, "no").withColumn("block", F.expr("cast(pmod(xxhash64(q), blocks) as int)")).select("no", "block", "q").join(asked, "q")
    schema = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(x: pa.Table, y: pa.Table) -> pa.Table:
        def out() -> Iterator[tuple]:
            for tree in map(pickle.loads, x.column("blob").to_pylist()):
                for q, i, v, floor in zip(*(y.column(c).to_pylist() for c in ("q", "id", "v", "floor")), strict=True):
                    for score, j in tree.search(i, _array([integers(v) or [0]])[0], k, floor):
                        yield q, j, score

        return pa.Table.from_batches(batches(out(), schema), schema)

    return left.groupBy("no", "block").cogroup(right.groupBy("no", "block")).applyInArrow(search, "q long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """found with rank, the k best of each query."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def search_forest(embeddings: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[DataFrame], int]:
    """The answers, the visits (q, no) of the three rounds, and the number of trees."""
    spark = embeddings.sparkSession
    raw = pick(embeddings, id_col, vec_col).toDF("id", "v").withColumn("v", F.expr("transform(v, x -> cast(x as double))")).where(VALID)
    # A query's own id can take one of the places, so k + 1 ids of equal vectors are as good as all.
    each = raw.groupBy("id", "v").agg(F.count("*").alias("n"))
    copies = Window.partitionBy("h", "v").orderBy("id")
    kept = each.withColumn("h", F.xxhash64("v")).withColumn("r", F.row_number().over(copies)).where(F.col("r") <= k + 1)
    rows = materialize(kept.select("id", "v", F.least("n", F.lit(k)).alias("n")), "objects")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space = _space(rows)
    if space is None:
        return empty, [], 0
    routes = _routes(rows, max(1, min(ROUTES, rows.count() // TREE)), space)
    trees = materialize(_trees(_placed(rows, routes, space), space), "trees")
    rings = trees.select("no", "route", "low", "high")
    count, radii = rings.count(), {r["route"]: r["high"] for r in rings.groupBy("route").agg(F.max("high").alias("high")).collect()}  # at most ROUTES rows
    asked = raw.where(F.col("id") % every == 0).distinct()
    asked = materialize(asked.select(F.monotonically_increasing_id().alias("q"), "id", "v", F.lit(None).cast("long").alias("floor")), "queries")
    nearest = Window.partitionBy("q").orderBy("least", "far", "no")
    found, rounds = None, []
    for most in (1, ROUND, None):
        visits = _admitted(asked, rings, count <= RINGS, routes, radii, space)
        for before in rounds:
            visits = visits.join(before, ["q", "no"], "left_anti")
        if most is not None:
            visits = visits.withColumn("turn", F.row_number().over(nearest)).where(F.col("turn") <= most)
        visits = materialize(visits.select("q", "no"), "visits")
        new = _visit(visits, asked, trees, k)
        found = materialize(_best(new if found is None else found.drop("rank").unionByName(new), k), "found")
        bound = found.where(F.col("rank") == k).select("q", F.col("score").alias("floor"))
        rounds.append(visits)
        if most is not None:
            asked = materialize(asked.drop("floor").join(bound, "q", "left").select("q", "id", "v", "floor"), "queries")
    return found.join(asked.select("q", F.col("id").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score"), rounds, count


def top_k(embeddings: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for each row whose id is divisible by `every`."""
    return search_forest(embeddings, every, k, id_col, vec_col)[0]
