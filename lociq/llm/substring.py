"""Exact substring deduplication over a log-structured fingerprint index.

Every task turns what it reads into sorted immutable runs of window hashes. Within a run only the first occurrence of a
window stays, so a passage that many documents share sends one entry a run. The runs, cut by hash range, meet in a
merge-join with each other and with the historical runs of the index; of equal windows the earliest is kept and the
others are answered to their runs. The answers become passages, each passage is verified on the text of both sides, and
the new windows are compacted into the index. Entries travel as packed columns of about nine bytes a window.

A window is `size` consecutive words [^\\x20\\x09-\\x0D]+ of one document, unchanged. A word is removed if a window that
covers it also starts earlier: in an earlier batch, a smaller id, or earlier in the same document.

Defined results: null and empty texts have no words; a null id sorts before all others; rows that share an id count as
one document, so exact repeats keep what one of them keeps (and a word position removed in one is removed in all);
an empty table gives an empty result; other columns are not read by the search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.text import U, WordIds, batches, binary, mix, pack, pack_signed, pack_sorted, slices, unpack, unpack_signed, unpack_sorted, windows, words_of
from lociq.session import materialize, new_path, partitions, pick, release, scratch

#: Windows of a run; bounds a task's memory whatever it reads.
RUN = 750_000
NULL_ID = -(1 << 63)
#: Run of the entries that come from the index: they are never answered. In a stored index it is less by the seed.
HISTORY = -1

_RUNS = pa.schema([("bucket", pa.int32()), ("run", pa.int64()), ("kind", pa.int8()), ("f", pa.binary()), ("d", pa.binary()), ("p", pa.binary()), ("ids", pa.binary())])
_RUNS_SQL = "bucket int, run long, kind byte, f binary, d binary, p binary, ids binary"


def _cover(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ranges [from, to) that windows of this size at ascending starts cover."""
    fresh = np.diff(starts, prepend=starts[0] - size - 1) > size
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last] + size


class _Runs:
    """Builds the runs of one task."""

    def __init__(self, size: int, buckets: int, seed: int, task: int):
        self.size, self.buckets, self.words = size, buckets, WordIds(seed)
        self.run = task << 32  # numbers of runs are those of a rerun too, or rows of a lost run would be missed
        self.docs: list[tuple[int, np.ndarray]] = []
        self.n = 0

    def add(self, doc_id: int | None, text: bytes | None) -> Iterator[tuple]:
        ids = self.words.of(words_of(text, False))
        if len(ids) >= self.size:
            self.docs.append((NULL_ID if doc_id is None else doc_id, ids))
            self.n += len(ids)
            if self.n >= RUN:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if not self.docs:
            return
        self.docs.sort(key=lambda x: x[0])
        size, run = self.size, self.run
        self.run += 1
        doc_ids = np.array([d for d, _ in self.docs], np.int64)
        count = np.array([len(x) - size + 1 for _, x in self.docs], np.int64)
        # One row of words; windows that reach over a border are left out.
        words = np.concatenate([x for _, x in self.docs])
        at = np.cumsum([0, *(len(x) for _, x in self.docs)])[:-1]
        d = np.repeat(np.arange(len(count)), count)
        p = np.arange(len(d)) - np.repeat(np.cumsum(count) - count, count)
        place = at[d] + p
        f = mix(windows(words, size)[place])
        self.docs, self.n = [], 0
        order = np.argsort(f, kind="stable")
        f, d, p, place = f[order], d[order], p[order], place[order]
        head = np.flatnonzero(np.diff(f, prepend=~f[:1]) != 0)
        of = np.repeat(head, np.diff(np.append(head, len(f))))
        later = np.flatnonzero(of != np.arange(len(f)))
        if len(later):
            first = of[later]
            same = np.ones(len(later), bool)
            for j in range(size):  # verified on the words themselves
                same &= words[place[later] + j] == words[place[first] + j]
            if not same.all():
                raise ArithmeticError("two windows share a fingerprint")
            gone = (doc_ids[d[later]] != doc_ids[d[first]]) | (p[later] != p[first])
            yield from self._answers(run, doc_ids[d[later]][gone], p[later][gone], doc_ids[d[first]][gone], p[first][gone])
        f, d, p = f[head], d[head], p[head]
        cuts = [0, *slices(f, self.buckets), len(f)]
        for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if hi > lo:
                used, back = np.unique(d[lo:hi], return_inverse=True)
                yield b, run, 0, pack_sorted(f[lo:hi]), pack(back.astype(U)), pack(p[lo:hi].astype(U)), pack_signed(doc_ids[used])

    def _answers(self, run: int, doc: np.ndarray, p: np.ndarray, doc0: np.ndarray, p0: np.ndarray) -> Iterator[tuple]:
        if len(doc):
            order = np.lexsort((p, doc))
            yield int(mix(np.array([run], U))[0] % U(self.buckets)), run, 1, pack_signed(doc[order]), pack_signed(p[order]), pack_signed(doc0[order]), pack_signed((p0 - p)[order])


def build_runs(docs: DataFrame, size: int, buckets: int, seed: int) -> DataFrame:
    """The sorted runs of docs(id, text), cut into hash ranges."""

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            from pyspark import TaskContext

            runs = _Runs(size, buckets, seed, TaskContext.get().partitionId())
            for b in it:
                for doc_id, text in zip(b.column(0).to_pylist(), binary(b.column(1)), strict=True):
                    yield from runs.add(doc_id, text)
            yield from runs.flush()

        yield from batches(rows(), _RUNS, 64)

    return docs.mapInArrow(make, _RUNS_SQL)


def _merge(it: Iterator[pa.RecordBatch], keep_index: bool) -> Iterator[tuple]:
    """One hash range: merges sorted runs; answers what is not the earliest of its window, with the earliest (kind 1 if
    that is of this batch, 2 if it is of the index). With keep_index also the compacted run of the earliest windows (kind 0)."""
    parts: list[tuple] = []
    for b in it:
        for bucket, run, kind, f, d, p, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if kind:
                yield bucket, run, kind, f, d, p, ids
            else:
                fs = unpack_sorted(f)
                parts.append((bucket, run, fs, unpack_signed(ids)[unpack(d).astype(np.int64)], unpack(p).astype(np.int64)))
    if not parts:
        return
    f = np.concatenate([x[2] for x in parts])
    order = np.argsort(f, kind="stable")  # merges the runs that are sorted already
    f = f[order]
    head = np.diff(f, prepend=~f[:1]) != 0
    multi = ~head
    multi[:-1] |= ~head[1:]
    if keep_index or multi.any():
        run = np.repeat([x[1] for x in parts], [len(x[2]) for x in parts])[order]
        doc = np.concatenate([x[3] for x in parts])[order]
        p = np.concatenate([x[4] for x in parts])[order]
    if multi.any():
        f2, run2, doc2, p2 = f[multi], run[multi], doc[multi], p[multi]
        order = np.lexsort((p2, doc2, run2 != HISTORY, f2))
        f2, run2, doc2, p2 = f2[order], run2[order], doc2[order], p2[order]
        first = np.flatnonzero(np.diff(f2, prepend=~f2[:1]) != 0)
        of = np.repeat(first, np.diff(np.append(first, len(f2))))
        gone = np.flatnonzero((run2 != HISTORY) & ((doc2 != doc2[of]) | (p2 != p2[of]) | (run2[of] == HISTORY)) & (of != np.arange(len(f2))))
        old = run2[of] == HISTORY
        order = gone[np.lexsort((p2[gone], doc2[gone], old[gone], run2[gone]))]
        cuts = np.flatnonzero((np.diff(run2[order], prepend=HISTORY - 1, append=HISTORY - 1) != 0) | (np.diff(old[order].astype(np.int8), prepend=2, append=2) != 0))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            o = order[lo:hi]
            yield 0, int(run2[o[0]]), 1 + int(old[o[0]]), pack_signed(doc2[o]), pack_signed(p2[o]), pack_signed(doc2[of[o]]), pack_signed(p2[of[o]] - p2[o])
    if keep_index:
        order = np.lexsort((p, doc, run != HISTORY, f))
        f, doc, p = f[order], doc[order], p[order]
        keep = np.flatnonzero(np.diff(f, prepend=~f[:1]) != 0)
        used, back = np.unique(doc[keep], return_inverse=True)
        yield parts[0][0], HISTORY, 0, pack_sorted(f[keep]), pack(back.astype(U)), pack(p[keep].astype(U)), pack_signed(used)


def _passages(it: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """The answers of whole runs to rows (id, packed starts, packed ends, passages (from, words, source id, source from))."""
    by_run: dict[int, list[tuple]] = {}
    for b in it:
        for run, kind, *row in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4, 5, 6)), strict=True):
            by_run.setdefault(run, []).append((*map(unpack_signed, row), kind == 2))
    for rows in by_run.values():
        doc, p, doc0, off = (np.concatenate([r[i] for r in rows]) for i in range(4))
        old = np.concatenate([np.full(len(r[0]), r[4]) for r in rows])
        order = np.lexsort((p, doc))
        doc, p, doc0, off, old = doc[order], p[order], doc0[order], off[order], old[order]
        cuts = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1)) if doc[0] > NULL_ID else np.flatnonzero(np.concatenate(([True], np.diff(doc) != 0)))
        step = np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(p) != 1) | (np.diff(doc0) != 0) | (np.diff(off) != 0) | (old[1:] != old[:-1])))
        begin = np.flatnonzero(step)
        until = np.append(begin[1:], len(p))
        borders = np.append(np.searchsorted(begin, cuts), len(begin))
        for k, (lo, hi) in enumerate(zip(cuts, np.append(cuts[1:], len(doc)), strict=True)):
            a, e = _cover(p[lo:hi], size)
            mine = slice(borders[k], borders[k + 1])
            passages = [
                {"from": int(p[i]), "words": int(j - i) + size - 1, "source": int(doc0[i]), "at": int(p[i] + off[i]), "old": bool(old[i])}
                for i, j in zip(begin[mine], until[mine], strict=True)
            ]
            yield int(doc[lo]), pack_sorted(a), pack_sorted(e), passages


_SPAN = pa.list_(pa.struct([("from", pa.int64()), ("words", pa.int64()), ("source", pa.int64()), ("at", pa.int64()), ("old", pa.bool_())]))


def _recut(index: DataFrame, buckets: int) -> DataFrame:
    """The runs of a stored index, cut into this call's hash ranges: the number of ranges may differ from call to call."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in it:
                for f, d, p, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    fs, at, ps, who = unpack_sorted(f), unpack(d).astype(np.int64), unpack(p), unpack_signed(ids)
                    cuts = [0, *slices(fs, buckets), len(fs)]
                    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        if hi > lo:
                            used, back = np.unique(who[at[lo:hi]], return_inverse=True)
                            yield k, HISTORY, 0, pack_sorted(fs[lo:hi]), pack(back.astype(U)), pack(ps[lo:hi]), pack_signed(used)

        yield from batches(rows(), _RUNS, 64)

    return pick(index, "f", "d", "p", "ids").mapInArrow(cut, _RUNS_SQL)


def find_repeats(docs: DataFrame, size: int = 20, index: DataFrame | None = None, keep_index: bool = False, seed: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """Rows (id, starts, ends, passages) of the documents that lose words, and the compacted index.

    docs(id, text); index: what an earlier call with the same seed returned, as read back from a table."""
    spark = docs.sparkSession
    buckets = partitions(spark)
    runs = build_runs(docs, size, buckets, seed)
    if index is not None:
        runs = runs.unionByName(_recut(index, buckets))
    merged = runs.repartitionById(buckets, F.pmod(F.col("bucket"), F.lit(buckets)).cast("int")).mapInArrow(lambda it: batches(_merge(it, keep_index), _RUNS, 64), _RUNS_SQL)
    compacted = None
    if keep_index:
        merged = materialize(merged, "runs")
        compacted = merged.where("kind = 0").withColumn("run", F.lit(HISTORY - seed).cast("long"))
    answers = merged.where("kind > 0").repartition(buckets, "run")
    schema = pa.schema([("id", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary()), ("passages", _SPAN)])
    found = answers.mapInArrow(
        lambda it: batches(_passages(it, size), schema, 500),
        "id long, starts binary, ends binary, passages array<struct<from:long,words:long,source:long,at:long,old:boolean>>",
    )
    return found, compacted


def _apply(it: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of rows (id, text, starts[], ends[], spans[], others): id, kept text or null if nothing goes, counts, hashes of the spans, others."""
    for b in it:
        out = []
        for text, starts, ends, spans in zip(binary(b.column(1)), *(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            words = words_of(text, False)
            n = len(words)
            checks = [{"from": s["from"], "words": s["words"], "hash": hashlib.blake2b(b" ".join(words[s["from"] : s["from"] + s["words"]]), digest_size=16).digest()} for s in spans or ()]
            keep = np.ones(n, bool)
            for a, e in zip(starts or (), ends or (), strict=True):
                for x, y in zip(unpack_sorted(a), unpack_sorted(e), strict=True):
                    keep[int(x) : int(y)] = False
            removed = n - int(keep.sum())
            if removed:
                words = [words[i] for i in np.flatnonzero(keep)]
            kept = b" ".join(words)
            out.append((kept if removed else None, n, removed, hashlib.sha256(kept).hexdigest(), checks))
        if out:
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types[1:6], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made, *b.columns[5:]], names=[*schema.names, *b.schema.names[5:]])


_CHECKS = pa.list_(pa.struct([("from", pa.int64()), ("words", pa.int64()), ("hash", pa.binary())]))
_APPLIED = pa.schema([("id", pa.int64()), ("kept", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("checks", _CHECKS)])


def dedup(
    docs: DataFrame,
    size: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    index: DataFrame | None = None,
    index_path: str | None = None,
    with_text: bool = False,
    carry: tuple[str, ...] = (),
    verify: bool = True,
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept], carried columns) of every row; kept is null where a document loses nothing.

    index: historical runs (a table that an earlier call wrote to its index_path); the number of shuffle partitions need
    not be that of the earlier call, and the fingerprints are those of the index. A passage that comes from history can
    only be verified where its text is at hand; within the batch every passage is hashed on both sides, and on a
    mismatch (two windows with one fingerprint) the search is repeated with other fingerprints. Those of an index are
    given, so there a mismatch is an error."""
    spark = docs.sparkSession
    names = [f"carried{i}" for i in range(len(carry))]
    wide = pick(docs, id_col, text_col, *carry).toDF("id", "text", *names)
    rows = wide.select("id", "text")
    types = "".join(f", {n} {wide.schema[n].dataType.simpleString()}" for n in names)
    seeds = range(8)
    if index is not None:
        stored = [HISTORY - r["run"] for r in index.select("run").distinct().limit(2).collect()]
        if len(stored) > 1:
            raise ValueError("the runs of the index have different fingerprints")
        seeds = stored or seeds
    with scratch(spark):
        for seed in seeds:
            found, compacted = find_repeats(rows, size, index, index_path is not None, seed)
            found = materialize(found, "repeats")
            release(spark)
            p = found.select("id", F.explode("passages").alias("s")).select("id", "s.*").where("not old").drop("old")  # the words of history are not at hand
            spans = p.select("id", "from", "words").unionByName(p.select(F.col("source").alias("id"), F.col("at").alias("from"), "words")).distinct()
            asked = spans.groupBy("id").agg(F.collect_list(F.struct("from", "words")).alias("spans"))
            cuts = found.groupBy("id").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
            todo = cuts.join(asked, "id", "full").withColumnRenamed("id", "key")
            joined = wide.join(todo, F.coalesce("id", F.lit(NULL_ID)) == F.col("key"), "left").select("id", "text", "starts", "ends", "spans", *names)
            applied = joined.mapInArrow(
                lambda it: _apply(it, _APPLIED),
                "id long, kept binary, n_words long, n_removed long, kept_sha256 string, checks array<struct<from:long,words:long,hash:binary>>" + types,
            )
            applied = materialize(applied if with_text else applied.withColumn("kept", F.lit(None).cast("binary")), "kept", keep=True)
            if not verify or not _mismatches(applied, p):
                break
        else:
            raise ArithmeticError("fingerprints collide under every seed" if index is None else "fingerprints collide under the seed of the index")
        if index_path is not None:
            compacted.write.parquet(index_path)
    kept = [F.decode("kept", "UTF-8").alias("kept")] if with_text else []
    return applied.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *kept, *[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)])


def _mismatches(applied: DataFrame, passages: DataFrame) -> int:
    """Passages whose words differ from those of their source."""
    h = applied.select(F.coalesce("id", F.lit(NULL_ID)).alias("id"), F.explode("checks").alias("c")).select("id", "c.*").distinct()
    left = passages.join(h, ["id", "from", "words"]).withColumnRenamed("hash", "h1").select("source", "at", "words", "h1").distinct()
    right = h.toDF("source", "at", "words", "h2")
    return left.join(right, ["source", "at", "words"]).where("h1 <> h2").limit(1).count()


def index_location(spark) -> str:
    """A fresh place for an index in the shared folder."""
    return new_path(spark, "index")
