"""The prefix trie of conversations, built as a Patricia tree.

A conversation is a path: the 16-byte digests of its turns (role, text) one after another, so the order of bytes is an
order of the trie. Paths are dealt out by ranges of (path, conv_id) and sorted. Within a range only branch, end and leaf
points are made, on a stack, from the common prefix of each path and the one before; their aggregates are complete when
they leave it, and only then is the edge above a point expanded into its unary nodes, by sums from its lower end.

Nodes that reach over a border of ranges are prefixes of the border's separator (whatever lies between two paths that
share a prefix has it too). These alone are sent on, as partial figures of each range, merged by node and folded up the
tree of separators. A separator is the shortest prefix that tells two neighbours of the sample apart, so these nodes are
few: at most ranges x turns of a separator, whatever the number of conversations. A group of copies is cut by conv_id
like any other range; the ids that end at such a node are hashed in order as they stream by.

What reaches the driver: about SAMPLED paths a range (a random share, for the separators) and the merged nodes of the
separators. A conversation is one row of 20 bytes a turn while it is sorted; a range keeps one row in memory for each
point that waits for its parent.

Defined results: rows without conv_id take no part; null role and text are empty; null turns come first, rows of one turn
are ordered by the digest of role and text; repeated rows are turns like others; a conversation that is left without turns
ends at the root; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.text import batches
from lociq.session import materialize, partitions, pick, scratch

#: Bytes of a turn's digest.
W = 16
#: Sampled paths for each range.
SAMPLED = 30
#: Conversation ids of one packed row of a node's ends.
CHUNK = 100_000
#: Most nodes of separators that are broadcast to find parents; beyond it Spark joins them like any table.
SMALL = 200_000
NO_ENDS = hashlib.sha256().hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: kind: 0 a finished node, whose parent may be border node (own, parent_depth); 1 part of a border node; 2 ends of one.
_LOCAL = pa.schema([("kind", pa.int8()), *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("own", pa.int32()), ("words", pa.int64()), ("range", pa.int32()), ("part", pa.int32()), ("ids", pa.binary())])
_LOCAL_SQL = "kind byte, " + NODE + ", own int, words long, range int, part int, ids binary"


def rebuilt(convs: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, path, words: conversation c begins with the first h turns of conversation c - c % every, h = crc32(c) %
    heads, and goes on with its own turns after its first h."""
    d = pick(convs, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.size(F.expr("filter(split(coalesce(text, ''), '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'), x -> x <> '')"))
    turns = d.select("conv_id", F.struct("turn", digest.alias("dg"), words.alias("w")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")).withColumn("base", F.expr(f"conv_id - conv_id % {every}"))
    own = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int"))
    first = own.where("conv_id = base").select("base", F.slice("own", 1, heads - 1).alias("head"))
    both = own.join(first, "base", "left").withColumn("all", F.expr("concat(slice(coalesce(head, slice(own, 1, 0)), 1, h), slice(own, h + 1, size(own)))"))
    return both.select("conv_id", F.unhex(F.array_join(F.col("all.dg"), "")).alias("path"), F.col("all.w").alias("words"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths share from their start."""
    low, high = 0, min(len(a), len(b)) // W
    if a[:W] != b[:W]:
        return 0
    while low < high:  # the first low turns are equal
        mid = (low + high + 1) // 2
        if a[low * W : mid * W] == b[low * W : mid * W]:
            low = mid
        else:
            high = mid - 1
    return low


def separators(sample: list[tuple[bytes, int]], ranges: int) -> list[tuple[bytes, int]]:
    """At most ranges - 1 keys that deal a sorted sample out evenly; paths as short as they can be."""
    out = []
    for i in sorted({len(sample) * r // ranges for r in range(1, ranges)} - {0}):
        (a, _), (b, conv_id) = sample[i - 1], sample[i]
        out.append((b, conv_id) if a == b else (b[: (common(a, b) + 1) * W], -(1 << 63)))
    return sorted(set(out))


def owners(seps: list[tuple[bytes, int]]) -> list[np.ndarray]:
    """For each separator, by depth: the first separator that has this prefix too. (owner, depth) names a border node."""
    out: list[np.ndarray] = []
    for i, (path, _) in enumerate(seps):
        row = np.full(len(path) // W + 1, i, np.int32)
        row[0] = 0
        if i:
            shared = common(seps[i - 1][0], path) + 1
            row[:shared] = out[-1][:shared]
        out.append(row)
    return out


class _Point:
    """An open point of the stack: what its members and closed children have added so far."""

    __slots__ = ("children", "depth", "ends", "ids", "leaves", "least", "members", "own", "saved", "waiting", "words")

    def __init__(self, depth: int, own: int | None, words: int):
        self.depth, self.own, self.words = depth, own, words
        self.members = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends = None  # a running hash; of a border node the ids themselves
        self.ids: list[int] = []
        self.waiting: list[list] = []  # rows of children that lack this node's conv_id


class RangeTrie:
    """The trie of one range of sorted paths."""

    def __init__(self, at: int, borders: list[tuple[bytes, np.ndarray]]):
        self.at, self.borders = at, borders
        self.path, self.words = b"", []
        self.parts: dict[tuple[int, int], int] = {}
        self.stack = [_Point(0, 0, 0)]

    def _row(self, kind: int, conv_id: int | None = None, depth: int | None = None, parent: int | None = None, n: int | None = None, children: int | None = None, leaves: int | None = None, saved: int | None = None, ends: str | None = None, own: int | None = None, words: int | None = None, part: int | None = None, ids: bytes | None = None) -> list:
        return [kind, conv_id, depth, parent, n, children, leaves, saved, ends, own, words, self.at, part, ids]

    def _owner(self, path: bytes) -> list[int]:
        """Owners of the border nodes along a path, by depth."""
        best: list[int] = [0]
        for border, own in self.borders:
            if (n := common(border, path) + 1) > len(best):
                best = own[:n].tolist()
        return best

    def _ends(self, p: _Point) -> list:
        key = (p.own, p.depth)
        self.parts[key] = self.parts.get(key, 0) + 1
        row = self._row(2, depth=p.depth, own=p.own, part=self.parts[key], ids=np.array(p.ids, np.int64).tobytes())
        p.ids = []
        return row

    def _close(self) -> Iterator[list]:
        """Takes the lowest point off the stack."""
        p, above = self.stack.pop(), self.stack[-1] if self.stack else None
        if above is not None:
            above.members += p.members
            above.least = p.least if above.least is None else min(above.least, p.least)
        for row in p.waiting:
            row[3] = p.least
            yield row
        if p.own is not None:
            if p.ids:
                yield self._ends(p)
            if p.members:
                yield self._row(1, p.least, p.depth, None, p.members, p.children, p.leaves, p.saved, own=p.own, words=p.words)
            return
        leaves, ends, children = p.leaves or 1, p.ends.hexdigest() if p.ends else NO_ENDS, p.children
        # The edge above the point, from its lower end: the point itself, then unary nodes.
        saved = p.saved
        for depth in range(p.depth, above.depth, -1):
            saved += (p.members - 1) * self.words[depth - 1]
            row = self._row(0, p.least, depth, p.least, p.members, children, leaves, saved, ends)
            ends, children = NO_ENDS, 1
            if depth > above.depth + 1:
                yield row
            elif above.own is not None:
                row[3], row[9], row[10] = None, above.own, above.depth
                yield row
            else:
                above.waiting.append(row)
        above.children += 1
        above.leaves += leaves
        above.saved += saved

    def add(self, conv_id: int, path: bytes, words: list[int]) -> Iterator[list]:
        shared, stack = common(self.path, path), self.stack
        while stack[-1].depth > shared:
            if stack[-2].depth < shared:  # a new branch on the edge above
                stack.insert(-1, _Point(shared, None, 0))
            yield from self._close()
        if path != self.path or len(stack) == 1:
            owner = self._owner(path)
            for depth in range(stack[-1].depth + 1, len(owner)):
                stack.append(_Point(depth, owner[depth], words[depth - 1]))
            if stack[-1].depth < len(words):
                stack.append(_Point(len(words), None, 0))
        self.path, self.words = path, words
        p = stack[-1]
        p.members += 1
        p.least = conv_id if p.least is None else min(p.least, conv_id)
        if p.own is not None:
            p.ids.append(conv_id)
            if len(p.ids) >= CHUNK:
                yield self._ends(p)
        elif p.ends is None:
            p.ends = hashlib.sha256(str(conv_id).encode())
        else:
            p.ends.update(f",{conv_id}".encode())

    def finish(self) -> Iterator[list]:
        while self.stack:
            yield from self._close()


def _built(seps: list[tuple[bytes, int]]):
    own = owners(seps)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list]:
            trie = None
            for b in it:
                for at, conv_id, path, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if trie is None or trie.at != at:
                        if trie is not None:
                            yield from trie.finish()
                        trie = RangeTrie(at, [(seps[i][0], own[i]) for i in (at - 1, at) if 0 <= i < len(seps)])
                    yield from trie.add(conv_id, path, words)
            if trie is not None:
                yield from trie.finish()

        yield from batches(rows(), _LOCAL)

    return run


def _numbered(seps: list[tuple[bytes, int]]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys = zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True)
            at = pa.array([bisect_right(seps, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([at, *b.columns], names=["range", *b.schema.names])

    return run


def _digested(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ends of border nodes in order -> one hash a node."""

    def rows() -> Iterator[tuple]:
        now, made = None, None
        for b in it:
            for own, depth, ids in zip(*(b.column(n).to_pylist() for n in ("own", "depth", "ids")), strict=True):
                text = ",".join(map(str, np.frombuffer(ids, np.int64).tolist()))
                if (own, depth) == now:
                    made.update(f",{text}".encode())
                    continue
                if now is not None:
                    yield (*now, made.hexdigest())
                now, made = (own, depth), hashlib.sha256(text.encode())
        if now is not None:
            yield (*now, made.hexdigest())

    yield from batches(rows(), pa.schema([("own", pa.int32()), ("depth", pa.int64()), ("ends", pa.string())]))


def folded(merged: list, own: list[np.ndarray]) -> list[tuple]:
    """Border nodes with the figures of their subtrees. merged: own, depth, least, members, children, leaves, saved, words."""
    nodes = {(r[0], r[1]): list(r) for r in merged}

    def above(o: int, d: int) -> tuple[int, int]:
        return (int(own[o][d - 1]) if own else 0, d - 1)

    for o, d in sorted(nodes, key=lambda k: -k[1]):
        r = nodes[o, d]
        r[5] = r[5] or 0 if r[4] else 1  # a node without children is a leaf
        r[6] += (r[3] - 1) * r[7]
        if d:
            up = nodes[above(o, d)]
            up[4] += 1
            up[5] += r[5]
            up[6] += r[6]
    return [(o, d, r[2], nodes[above(o, d)][2] if d else None, *r[3:7]) for (o, d), r in nodes.items()]


def trie(paths: DataFrame, ranges: int | None = None, seed: int = 7) -> DataFrame:
    """The nodes of the trie of paths (conv_id, path, words)."""
    spark = paths.sparkSession
    ranges = ranges or partitions(spark)
    with scratch(spark):
        paths = materialize(paths, "paths")
        total = paths.count()
        picked = paths.select("path", "conv_id").sample(min(1.0, SAMPLED * ranges / max(1, total)), seed) if total > SAMPLED * ranges else paths.select("path", "conv_id")
        seps = separators(sorted((bytes(r[0]), r[1]) for r in picked.collect()), ranges)
        numbered = paths.select("conv_id", "path", "words").mapInArrow(_numbered(seps), "range int, conv_id long, path binary, words array<int>")
        dealt = numbered.repartitionById(ranges, "range").sortWithinPartitions("range", "path", "conv_id")
        local = materialize(dealt.mapInArrow(_built(seps), _LOCAL_SQL), "tries", keep=True)
    own = owners(seps)
    merged = local.where("kind = 1").groupBy("own", "depth").agg(F.min("conv_id"), *(F.sum(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("words"))
    border = spark.createDataFrame(folded([tuple(r) for r in merged.collect()], own), "own int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    small = border.count() <= SMALL
    ends = local.where("kind = 2").select("own", "depth", "range", "part", "ids").repartition("own", "depth").sortWithinPartitions("own", "depth", "range", "part")
    digests = ends.mapInArrow(_digested, "own int, depth long, ends string")
    heads = border.join(digests, ["own", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS)))
    names = [c.split()[0] for c in NODE.split(", ")]
    found = border.select("own", F.col("depth").alias("words"), F.col("conv_id").alias("above"))
    inner = local.where("kind = 0").join(F.broadcast(found) if small else found, ["own", "words"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return heads.select(*names).union(inner.select(*names))


#: The trie by brute prefixes: every rebuilt conversation gives each of its prefixes.
ORACLE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, CRC % 4 AS h FROM t),
r AS (SELECT c.conv_id, 0 AS own, i, role, text FROM c JOIN t ON t.conv_id = c.base AND i <= h UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d, md5(length(role)::VARCHAR || ':' || role || text) AS k, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM r),
p AS (SELECT conv_id, d, w, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM n UNION ALL SELECT conv_id, 0, 0, '' FROM c),
q AS (SELECT *, max(d) OVER (PARTITION BY conv_id) = d AS ends FROM p),
g AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ids FROM q GROUP BY d, path),
kids AS (SELECT d - 1 AS d, left(path, 32 * (d - 1)::INT) AS path, count(*) AS kids FROM g WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT g.*, coalesce(kids, 0) AS kids FROM g LEFT JOIN kids USING (d, path)),
up AS (SELECT up AS d, left(path, 32 * up::INT) AS path, sum((kids = 0)::INT) AS leaves, sum((n_convs - 1) * w) AS saved FROM (SELECT *, unnest(range(d + 1)) AS up FROM f) GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, o.conv_id AS parent_conv_id, f.n_convs, f.kids AS n_children, up.leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, sha256(coalesce(f.ids, '')) AS ends_sha256
FROM f JOIN up ON up.d = f.d AND up.path = f.path LEFT JOIN f o ON o.d = f.d - 1 AND o.path = left(f.path, 32 * (f.d - 1)::INT)"""
