"""Exact n-gram Jaccard join by PartEnum signatures.

Sets of word shingles are put into size bands so that linked sets stand in the same or neighbouring bands; within an
instance (two neighbouring bands) a Jaccard bound is a bound k on the symmetric difference. The feature domain is hashed
into n1 * n2 cells: n1 partitions of n2 parts. By the pigeonhole principle two linked sets differ by at most k2 features
in some partition, hence agree on all features of some n2 - k2 of its parts. The signature of each (partition, subset of
parts) is emitted, so linked sets share one. n1, n2 and k2 are chosen by band.

Signatures of few features would gather unrelated sets. Where n1 is large, `spare` more partitions are added, which
makes spare + 1 partitions agree; a set with at most `spare` weak partitions may then leave its weak signatures out,
and a set with more emits all of them. Either way two linked sets still share a signature.

Sharing a signature makes sets candidates. A parity sketch (which hashed cells hold an odd number of features) gives a
lower bound on the symmetric difference and drops most of those that are not linked; every link is verified on the whole
sets. Groups that have one member in common, which shares most signatures with the others, are taken together.

A group is never compared pair by pair. Its consensus H holds the features that most of its members have. With
s = num / (num + den), sets i and j are linked if |i and j| >= s (|i| + |j|). The hub h is the member with the largest
|h and H| - s |h|; it is compared with all others. A linked pair then is joined through h, or else
  - shares at least s (least + |j|) - |j and H| features outside H, least being the smallest size in the group, so that
    the first features of j outside H (in the order of their hashes) are enough to meet in, or
  - shares nothing outside H and lacks a feature of H in common: otherwise |i and j| = |i and H| + |j and H| - |H|, and
    as no member has a larger |h and H| - s |h|, both are linked with h.
So members are grouped anew by features outside H that they have and by features of H that they lack; both are what
fewer than most members do, so groups halve and soon end. Groups of up to SHARE members are settled so within a task;
of a larger one, SHARE members or so vote on the consensus (any H gives right results), all others meet it, and then the
hub, in any number of tasks, and its parts are groups of the next round. Work follows the rows of the groups and not their
squares. Equal sets are one node throughout.

Defined results: lower-cased A-Z, words [^\\x20\\x09-\\x0D]+; fewer words than a shingle make one shingle; a null or empty
text has no shingles, is linked with nothing and is its own component; a row without id has no component unless another
row gives it one (where candidates are numbered it stands under the least id, which can add candidates but no link);
rows that share an id are rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.text import U, WordIds, batches, binary, mix, pack, pack_signed, pack_sorted, shingle_set, slices, unpack, unpack_signed, unpack_sorted, words_of
from lociq.operators.components import connected_components
from lociq.session import materialize, partitions, pick, release, scratch

#: Signatures of a run; bounds a task's memory.
RUN = 500_000
#: Sets of one signature in a run above which only one of them is sent to the signature's bucket.
HOT = 64
#: Features that a signature should hold on average, and those below which it is weak.
AIM, WEAK = 3.0, 1
NULL_ID = -(1 << 63)

#: Members of a group that one task settles, and that one copy of a larger group's consensus serves.
SHARE = 128
#: Bits that say which keys may be candidates.
MARKS = 1 << 23
#: Slices in which the groups of the first round are settled one after the other: as little of their sets is on disk at once.
SLICES = 4

_RUNS = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("f", pa.binary()), ("d", pa.binary()), ("ids", pa.binary()), ("id", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("sketch", pa.list_(pa.int64()))])
_RUNS_SQL = "bucket int, kind byte, f binary, d binary, ids binary, id long, n long, node binary, sketch array<long>"
_FOUND = pa.schema([("gid", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("sketch", pa.list_(pa.int64()))])
_FOUND_SQL = "gid long, id long, n long, node binary, sketch array<long>"


class Bands:
    """Size bands and the signature plan of each instance for the bound num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]

    def of(self, n: int) -> int:
        while self.upper(len(self.low) - 1) < n:
            self.low.append(self.upper(len(self.low) - 1) + 1)
        return int(np.searchsorted(self.low, n, "right")) - 1

    def upper(self, band: int) -> int:
        return max(self.low[band], self.low[band] * self.den // self.num)

    @cache  # noqa: B019
    def plan(self, instance: int) -> tuple[int, int, int, int]:
        """(n1, n2, k2, spare) of the instance of bands instance - 1 and instance."""
        self.of(self.low[-1])
        k = 2 * self.upper(instance) * (self.den - self.num) // (self.den + self.num)
        least = self.low[max(0, instance - 1)]
        if k == 0:
            return 1, 1, 0, 0
        best = None
        for k2 in range(1, min(k, 5) + 1):
            base = ceil((k + 1) / (k2 + 1))
            spare = ceil(0.15 * base) + 1 if base >= 8 else 0
            rest = ceil((k + 1) / base) - 1
            for n2 in range(rest + 1, rest + 5):
                held = least / (base + spare) * (n2 - rest) / n2
                cost = (base + spare) * comb(n2, rest)
                rank = (0, cost, -held) if held >= AIM else (1, -held, cost) if cost <= 600 else (2, cost, -held)
                if best is None or rank < best[0]:
                    best = rank, (base + spare, n2, rest, spare)
        return best[1]


class Signer:
    """Signatures of shingle sets."""

    def __init__(self, num: int, den: int):
        self.bands = Bands(num, den)
        self.subsets: dict[tuple[int, int], np.ndarray] = {}

    def of(self, features: np.ndarray) -> np.ndarray:
        band = self.bands.of(len(features))
        self.bands.of(self.bands.upper(band) + 1)
        return np.concatenate([self._instance(features, i) for i in (band, band + 1)])

    def _instance(self, h: np.ndarray, instance: int) -> np.ndarray:
        n1, n2, k2, spare = self.bands.plan(instance)
        salt = U((instance * 0x9E3779B97F4A7C15) & (2**64 - 1))
        if (n2, k2) not in self.subsets:
            self.subsets[n2, k2] = np.array(list(combinations(range(n2), n2 - k2)), np.int64)
        subsets = self.subsets[n2, k2]
        g = mix(h + salt)
        cell = ((g >> U(32)) * U(n1 * n2) >> U(32)).astype(np.int64)
        count = np.bincount(cell, minlength=n1 * n2)
        total = np.concatenate((np.zeros(1, U), np.cumsum(mix(g + U(1))[np.argsort(cell, kind="stable")], dtype=U)))
        ends = np.cumsum(count)
        sums = (total[ends] - total[ends - count]).reshape(n1, n2)
        held = count.reshape(n1, n2)[:, subsets].sum(axis=2)
        tag = np.arange(n1 * len(subsets), dtype=U).reshape(n1, -1) * U(0xD6E8FEB86659FD93)
        keys = mix(mix(sums[:, subsets].sum(axis=2, dtype=U) + tag) ^ salt)
        if spare:
            weak = held < WEAK
            if weak.any(axis=1).sum() <= spare:
                return keys[~weak]
        return keys.reshape(-1)


def set_key(features: np.ndarray) -> bytes:
    """A 128-bit identity of a set."""
    return hashlib.blake2b(np.ascontiguousarray(features).tobytes(), digest_size=16).digest()


def sketch(features: np.ndarray) -> list[int]:
    """Parities of the number of features in each of 2^m >= size hashed cells, as 64-bit words; halves fold by xor."""
    cells = max(64, 1 << (len(features) - 1).bit_length())
    odd = np.bincount((mix(features + U(0x0DD)) & U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _folded(x: str, y: str) -> str:
    half = f"cast(size({x}) / 2 as int)"
    return f"case when size({x}) > size({y}) then zip_with(slice({x}, 1, {half}), slice({x}, {half} + 1, {half}), (u, v) -> u ^ v) else {x} end"


def _plausible(num: int, den: int) -> str:
    """SQL: the sizes na, nb and sketches ka, kb allow a link."""
    least = f"aggregate(zip_with({_folded('ka', 'kb')}, {_folded('kb', 'ka')}, (u, v) -> bit_count(u ^ v)), 0, (u, v) -> u + v)"
    return f"na * {den} >= nb * {num} and nb * {den} >= na * {num} and {least} * {den + num} <= (na + nb) * {den - num}"


_NO_SET = (None, None, None, None)


def signature_runs(docs: DataFrame, k: int, num: int, den: int, buckets: int) -> DataFrame:
    """One pass over docs(id, text): of every row its set's size, identity and sketch (kind 3), and sorted runs of
    (signature, id), cut into hash ranges; the signatures of a set that a task meets again are left out."""

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, signer = WordIds(), Signer(num, den)
        seen: set[int] = set()

        def flush(keys: list[np.ndarray], ids: list[int]) -> Iterator[tuple]:
            f = np.concatenate(keys) >> U(16)
            d = np.repeat(np.array(ids, np.int64), [len(x) for x in keys])
            order = np.lexsort((d, f))
            f, d = f[order], d[order]
            fresh = (np.diff(f, prepend=~f[:1]) != 0) | (np.diff(d, prepend=~d[:1]) != 0)
            f, d = f[fresh], d[fresh]
            head = np.flatnonzero(np.diff(f, prepend=~f[:1]) != 0)
            many = np.diff(np.append(head, len(f)))
            hot = np.repeat(many > HOT, many)
            first = np.zeros(len(f), bool)
            first[head] = True
            if hot.any():
                # Any task may read them; the place depends on the rows alone, so that a rerun sends them there again.
                yield int((f[hot] ^ mix(d[hot].view(U))).sum(dtype=U) % U(buckets)), 1, pack_sorted(f[hot]), b"", pack_signed(d[hot]), *_NO_SET
            for kind, mask in ((0, ~hot), (2, hot & first)):
                fk, dk = f[mask], d[mask]
                cuts = [0, *slices(fk << U(16), buckets), len(fk)]
                for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if hi > lo:
                        used, back = np.unique(dk[lo:hi], return_inverse=True)
                        yield b, kind, pack_sorted(fk[lo:hi]), pack(back.astype(U)), pack_signed(used), *_NO_SET

        def rows() -> Iterator[tuple]:
            keys: list[np.ndarray] = []
            ids: list[int] = []
            held = 0
            for b in it:
                for i, t in zip(b.column(0).to_pylist(), binary(b.column(1)), strict=True):
                    s = shingle_set(words.of(words_of(t, True)), k)
                    if not len(s):
                        yield int(mix(np.array([0 if i is None else i], np.int64).view(U))[0] % U(buckets)), 3, None, None, None, i, 0, None, None
                        continue
                    key = set_key(s)
                    yield int.from_bytes(key[:8], "big") % buckets, 3, None, None, None, i, len(s), key, sketch(s)
                    if key in seen:
                        continue
                    seen.add(key)
                    keys.append(signer.of(s))
                    ids.append(NULL_ID if i is None else i)
                    held += len(keys[-1])
                    if held >= RUN:
                        yield from flush(keys, ids)
                        keys, ids, held = [], [], 0
            if keys:
                yield from flush(keys, ids)

        yield from batches(rows(), _RUNS, 512)

    return docs.mapInArrow(make, _RUNS_SQL)


def _groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash range: the sets as they came (without gid), and (gid, id) of the signatures that several ids share, one
    group for all signatures of the same ids."""
    f, d, flag = [], [], []
    for b in it:
        is_set = pc.equal(b.column(1), 3)
        said = b.filter(is_set)
        if said.num_rows:
            yield pa.RecordBatch.from_arrays([pa.nulls(said.num_rows, pa.int64()), *said.columns[5:]], schema=_FOUND)
        b = b.filter(pc.invert(is_set))
        for kind, fb, db, ids in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
            fs = unpack_sorted(fb)
            who = unpack_signed(ids)
            if kind == 1:
                yield _pairs(mix(fs).view(np.int64), who)
            else:
                f.append(fs)
                d.append(who[unpack(db).astype(np.int64)])
                flag.append(np.full(len(fs), kind == 2))
    if not f:
        return
    f, d, flag = np.concatenate(f), np.concatenate(d), np.concatenate(flag)
    order = np.argsort(f, kind="stable")
    f, d, flag = f[order], d[order], flag[order]
    same = np.diff(f, prepend=~f[:1]) == 0
    multi = same.copy()
    multi[:-1] |= same[1:]
    multi |= flag
    f, d, flag = f[multi], d[multi], flag[multi]
    if not len(f):
        return
    order = np.lexsort((d, f))
    f, d, flag = f[order], d[order], flag[order]
    head = np.flatnonzero(np.diff(f, prepend=~f[:1]) != 0)
    many = np.diff(np.append(head, len(f)))
    gid = np.add.reduceat(mix(d.view(U) + U(77)), head) + many.astype(U)
    hot = np.logical_or.reduceat(flag, head)
    gid = np.where(hot, mix(f[head]), gid)
    _, one = np.unique(gid, return_index=True)
    keep = np.zeros(len(head), bool)
    keep[one] = True
    keep = np.repeat(keep, many)
    yield _pairs(np.repeat(gid, many)[keep].view(np.int64), d[keep])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(a), t) for t in _FOUND.types[2:]]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *none], schema=_FOUND)


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the ascending y are in the ascending x."""
    return x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y if len(x) else np.zeros(len(y), bool)


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    inter = int(_shared(x, y).sum())
    return den * inter >= num * (len(x) + len(y) - inter)


def _consensus(sets: list[np.ndarray]) -> np.ndarray:
    features, n = np.unique(np.concatenate(sets), return_counts=True)
    return features[2 * n > len(sets)]


def _keys(y: np.ndarray, inside: np.ndarray, most: np.ndarray, least: int, num: int, den: int) -> np.ndarray:
    """What y shares with a partner to which it is linked, but not through the hub; inside: which of y are in most."""
    least = max(least, -(-num * len(y) // den))  # no smaller set is linked to y
    need = -(((num + den) * int(inside.sum()) - num * (least + len(y))) // (num + den))
    own = y[~inside]
    if need > 0:
        return own[: max(0, len(own) - need + 1)]
    return np.concatenate((own, mix(most[~_shared(y, most)] + U(0x1AC))))


def settle(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join whatever links of these sets join; a set is given by its ascending features."""
    label, out, seen, todo = list(range(len(sets))), [], set(), [tuple(range(len(sets)))]

    def find(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    def meet(i: int, j: int) -> None:
        if find(i) != find(j) and _linked(sets[i], sets[j], num, den):
            label[find(j)] = find(i)
            out.append((i, j))

    while todo:
        group = todo.pop()
        if len({find(i) for i in group}) < 2:
            continue
        if len(group) == 2:
            meet(*group)
            continue
        most = _consensus([sets[i] for i in group])
        inside = {i: _shared(most, sets[i]) for i in group}
        hub = max(group, key=lambda i: ((num + den) * int(inside[i].sum()) - num * len(sets[i]), -i))
        for i in group:
            meet(hub, i)
        if len({find(i) for i in group}) < 2:
            continue
        least, by_key = min(len(sets[i]) for i in group), {}
        for i in group:
            if i != hub:
                for key in _keys(sets[i], inside[i], most, least, num, den).tolist():
                    by_key.setdefault(key, []).append(i)
        new = {tuple(g) for g in by_key.values() if len(g) > 1} - seen
        seen |= new
        todo.extend(new)
    return out


def _by_group(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[np.ndarray]]]:
    """(gid, nodes, sets) of rows (gid, node, set) that come ordered by gid."""
    gid, nodes, sets = None, [], []
    for batch in it:
        for g, node, features in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if g != gid and nodes:
                yield gid, nodes, sets
                nodes, sets = [], []
            gid = g
            nodes.append(node)
            sets.append(np.frombuffer(features, U))
    if nodes:
        yield gid, nodes, sets


_SETTLED = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("gid", pa.int64()), ("part", pa.int32()), ("node", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("features", pa.binary())])
_SETTLED_SQL = "a binary, b binary, gid long, part int, node binary, n long, least long, features binary"


def _settle_groups(num: int, den: int):
    """Of rows (c, gid, part, node, n, least, set) that come ordered by gid: links (a, b) of the groups of one part, and
    the rows of larger groups as they are."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, nodes, sets = None, [], []

        def found() -> Iterator[tuple]:
            for i, j in settle(sets, num, den) if nodes else ():
                yield nodes[i], nodes[j], *[None] * 6

        for b in it:
            one = pc.equal(b.column(0), 1)
            large = b.filter(pc.invert(one))
            if large.num_rows:
                none = [pa.nulls(large.num_rows, pa.binary())] * 2
                yield pa.RecordBatch.from_arrays([*none, *(c.cast(t) for c, t in zip(large.columns[1:], _SETTLED.types[2:], strict=True))], schema=_SETTLED)
            b = b.filter(one)
            for g, node, features in zip(*(b.column(i).to_pylist() for i in (1, 3, 6)), strict=True):
                if g != gid:
                    yield from batches(found(), _SETTLED, 5000)
                    nodes, sets = [], []
                gid = g
                nodes.append(node)
                sets.append(np.frombuffer(features, U))
        yield from batches(found(), _SETTLED, 5000)

    return run


def _vote():
    """The consensus of each group of voters."""
    schema = pa.schema([("gid", pa.int64()), ("most", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(((gid, _consensus(sets).tobytes()) for gid, _, sets in _by_group(it)), schema, 100)

    return run


def _score(num: int, den: int):
    """Of rows (gid, node, set, least, consensus): the node's claim to be the hub, and its keys."""
    schema = pa.schema([("gid", pa.int64()), ("node", pa.binary()), ("score", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in it:
                for gid, node, features, least, consensus in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    x, most = np.frombuffer(features, U), np.frombuffer(consensus, U)
                    inside = _shared(most, x)
                    score = (num + den) * int(inside.sum()) - num * len(x)
                    yield gid, node, score, _keys(x, inside, most, least, num, den).view(np.int64)

        yield from batches(rows(), schema, 500)

    return run


def _compare(num: int, den: int):
    """Of rows (gid, node, set, hub, hub's set): whether they are linked."""
    schema = pa.schema([("gid", pa.int64()), ("node", pa.binary()), ("a", pa.binary()), ("linked", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in it:
                for gid, node, features, a, sa in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield gid, node, a, _linked(np.frombuffer(sa, U), np.frombuffer(features, U), num, den)

        yield from batches(rows(), schema, 5000)

    return run


def _features(k: int):
    """The whole sets of rows (node, text) whose text still has the set of that node."""
    schema = pa.schema([("node", pa.binary()), ("features", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordIds(), set()

        def out() -> Iterator[tuple]:
            for b in it:
                for node, t in zip(b.column(0).to_pylist(), binary(b.column(1)), strict=True):
                    s = shingle_set(words.of(words_of(t, True)), k)
                    if len(s) and node not in seen and set_key(s) == node:
                        seen.add(node)
                        yield node, s.tobytes()

        yield from batches(out(), schema, 500)

    return run


def _first_groups(members: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """(gid, node) of groups that hold those of members(gid, node): all with the same most central member are one. A pair
    alone in its group goes if the sketches rule it out."""
    sized = members.join(members.groupBy("gid").agg(F.count("*").alias("m")).where("m > 1"), "gid")
    sized = materialize(sized.join(sized.groupBy("node").agg(F.sum("m").alias("degree")), "node"), "degrees")
    hubs = sized.groupBy("gid").agg(F.max(F.struct("degree", "node")).alias("hub"))
    star = sized.join(hubs.select("gid", F.col("hub.node").alias("a")), "gid").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    ka = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("ka"), F.col("n").alias("na"))
    kb = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("kb"), F.col("n").alias("nb"))
    alone = star.groupBy("a").agg((F.count("*") == 1).alias("alone"))
    star = materialize(star.join(alone, "a").join(kb, "b").join(ka, "a").where(~F.col("alone") | F.expr(_plausible(num, den))).select("a", "b"), "star")
    # A family of near copies is many groups of more or less the same members, one for each signature. Of groups too large
    # for one task, one whose central member lies in a larger one joins it: each member then is in the family once, and not
    # once for each signature. No pair parts, so no link is lost.
    size = star.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") >= SHARE)
    inner = star.join(size, "a").join(size.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b")
    inner = inner.where((F.col("m") > F.col("mb")) | ((F.col("m") == F.col("mb")) & (F.col("a") < F.col("b"))))
    family = connected_components(inner.select("a", "b")).select(F.col("node").alias("a"), "component")
    star = star.join(family, "a", "left").select(F.coalesce("component", "a").alias("gid"), "a", "b")
    return star.select(F.xxhash64("gid").alias("gid"), F.explode(F.array("a", "b")).alias("node")).distinct()


def _round(members: DataFrame, sets: DataFrame, num: int, den: int, slices: int = 1) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Links (a, b) of the groups in members(gid, node, n), and the groups and their sets(node, features) for the next
    round, if any. The sets cross the network once to their groups; only those of large groups are written."""
    sizes = members.groupBy("gid").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("c"), F.min("n").alias("least"))
    dealt = materialize(members.join(sizes, "gid").withColumn("part", F.pmod(F.xxhash64("node"), F.col("c")).cast("int")), "dealt")
    settled = None
    for i in range(slices):
        some = dealt.where(F.pmod(F.xxhash64("gid"), F.lit(slices)) == i)
        both = some.join(sets, "node").select("c", "gid", "part", "node", "n", "least", "features")
        both = both.repartition("gid", "part").sortWithinPartitions("gid", "part")
        one = materialize(both.mapInArrow(_settle_groups(num, den), _SETTLED_SQL), "settled")
        settled = one if settled is None else settled.unionByName(one)
        release(members.sparkSession)
    links = settled.where("a is not null").select("a", "b")
    large = settled.where("a is null").select("gid", "part", "node", "n", "least", "features")
    if large.isEmpty():
        return links, None, None
    # What all members of a large group meet is dealt out in copies, so that no group is one task's burden.
    copies = large.select("gid", "part", "least").distinct()
    voters = large.where("part = 0").select("gid", "node", "features").repartition("gid").sortWithinPartitions("gid")
    voted = materialize(voters.mapInArrow(_vote(), "gid long, most binary"), "voted")
    met = large.join(voted.join(copies.select("gid", "part"), "gid"), ["gid", "part"]).select("gid", "node", "features", "least", "most")
    scored = materialize(met.mapInArrow(_score(num, den), "gid long, node binary, score long, keys array<long>"), "scored")
    hubs = scored.groupBy("gid").agg(F.max(F.struct("score", "node")).alias("hub")).select("gid", F.col("hub.node").alias("a"))
    own = large.select("gid", F.col("node").alias("a"), F.col("features").alias("sa"))
    hubs = hubs.join(own, ["gid", "a"]).join(copies.select("gid", "part"), "gid")
    star = large.join(hubs, ["gid", "part"]).where("a <> node").select("gid", "node", "features", "a", "sa")
    compared = materialize(star.mapInArrow(_compare(num, den), "gid long, node binary, a binary, linked boolean"), "compared")
    # Where all members are linked to the hub, nothing is left to find.
    torn = compared.where("not linked").select("gid").distinct()
    keyed = scored.join(torn, "gid", "left_semi").join(compared, ["gid", "node"]).select("gid", F.explode("keys").alias("key"), "node", "linked")
    keyed = keyed.select(F.xxhash64("gid", "key").alias("gid"), "node", "linked")
    held = keyed.groupBy("gid").agg(
        F.count("*").alias("m"), F.min("linked").alias("joined"),
        F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s2"),
    )
    one = held.where("m > 1 and not joined").groupBy("m", "s1", "s2").agg(F.min("gid").alias("gid")).select("gid")
    later = keyed.join(one, "gid").select("gid", "node").join(large.select("node", "n").distinct(), "node").select("gid", "node", "n")
    kept = large.select("node", "features").dropDuplicates(["node"])
    return links.unionByName(compared.where("linked").select("a", F.col("node").alias("b"))), materialize(later, "members"), kept


def maybe_in(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose key is in wanted, and a few others: MARKS bits say which hashes of keys occur. What the join that
    follows would drop then is not shuffled."""
    at = f"pmod(xxhash64(key), {MARKS})"
    word, bit = F.expr(f"{at} div 64"), F.expr(f"shiftleft(1L, cast({at} % 64 as int))")
    every = rows.sparkSession.range(MARKS // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits"))
    marked = wanted.select(word.alias("w"), bit.alias("bits")).unionByName(every).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    words = marked.agg(F.sort_array(F.collect_list(F.struct("w", "bits"))).alias("x")).select(F.col("x.bits").alias("words"))
    return rows.join(F.broadcast(words), F.get("words", word.cast("int")).bitwiseAND(bit) != 0, "left_semi")  # one row of MARKS bits


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: sets link when den * |A and B| >= num * |A or B|; component_id is the
    smallest id reachable by links. The result is written; what was written on the way is gone."""
    spark = docs.sparkSession
    with scratch(spark):
        buckets = partitions(spark)
        rows = pick(docs, id_col, text_col).toDF("id", "text")
        runs = signature_runs(rows, k, num, den, buckets).repartitionById(buckets, F.col("bucket"))
        found = materialize(runs.mapInArrow(_groups, _FOUND_SQL), "groups")
        release(spark)
        known = found.where("gid is null").drop("gid")
        nodes = known.where("node is not null").groupBy("node").agg(F.min("id").alias("id"))
        ids = known.where("node is not null").select(F.coalesce("id", F.lit(NULL_ID)).alias("id"), "node").distinct()
        members = materialize(found.where("gid is not null").select("gid", "id").join(ids, "id").select("gid", "node").distinct(), "members")

        sketches = known.where("node is not null").groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("n").alias("n"))
        sketches = materialize(sketches.join(members.select("node").distinct(), "node"), "sketches")
        members = materialize(_first_groups(members, sketches, num, den).join(sketches.select("node", "n"), "node").select("gid", "node", "n"), "members")

        # The whole sets of the candidates, from their texts.
        wanted = members.select("node").distinct().join(nodes, "node").select(F.coalesce("id", F.lit(NULL_ID)).alias("key"), "node")
        key = F.coalesce("id", F.lit(NULL_ID))
        texts = maybe_in(rows.withColumn("key", key), wanted).join(wanted, "key").select("node", "text")
        sets = materialize(texts.mapInArrow(_features(k), "node binary, features binary"), "features")
        release(spark)
        if not sets.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # rows that share id and text
            sets = sets.dropDuplicates(["node"])

        links, members, sets = _round(members, sets, num, den, SLICES)
        while members is not None:
            more, members, sets = _round(members, sets, num, den)
            links = links.unionByName(more)
        found = connected_components(links)

        least = nodes.join(found, "node").groupBy("component").agg(F.min("id").alias("least"))
        joined = found.join(least, "component").select("node", "least")
        per_node = nodes.join(joined, "node", "left").select("node", F.coalesce("least", "id").alias("component_id"))
        out = known.join(per_node, "node", "left")
        return materialize(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")), "components", keep=True)
