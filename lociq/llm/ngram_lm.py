"""Perplexity under a class-based bigram model with Brown's exchange clustering.

Every word stands for a symbol: itself if it is among the `symbols` most frequent, otherwise its ending (among the
`endings` most frequent endings) or one common symbol. Exchange clustering moves symbols between `classes` classes for as
long as the likelihood of the class bigrams rises, in at most `rounds` rounds. A text's probability is the product, over its words and one end, of
P(class | class before) * P(word | class), both smoothed; a class keeps half a count for words it has not seen.

Counts of words and of symbol bigrams cover all training texts. What reaches the driver is bounded: the `head` most
frequent words, and symbol bigrams of at most (symbols + endings + 1)^2 cells. Words outside the head are joined with
their counts by a shuffle; none of them is frequent, for the head holds those, so no key of that join is hot.

Defined results: a null text is empty, so it has one token, its end; a null id counts as an empty string for the fold;
with no training text all counts are zero and scores are those of the smoothing; repeated rows each have their row; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.text import batches, binary, words_of
from lociq.session import materialize, pick

#: Words a task counts before it hands its counts on.
FLUSH = 600_000


def held_out(doc_id: int | None, folds: int = 5) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 1


def count_words(docs: DataFrame, folds: int) -> DataFrame:
    """(word, n) over the training documents of docs(id, text); the empty word counts texts, that is ends."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            seen: Counter = Counter()
            for b in it:
                for i, t in zip(b.column(0).to_pylist(), binary(b.column(1)), strict=True):
                    if not held_out(i, folds):
                        seen.update(words_of(t, True))
                        seen[b""] += 1
                        if len(seen) >= FLUSH:
                            yield from seen.items()
                            seen = Counter()
            yield from seen.items()

        yield from batches(rows(), schema, 20000)

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Symbols:
    """word -> symbol number; endings are the last `width` bytes."""

    words: dict[bytes, int]
    ends: dict[bytes, int]
    width: int = 3

    @property
    def size(self) -> int:
        return len(self.words) + len(self.ends) + 1

    def of(self, word: bytes) -> int:
        k = self.words.get(word)
        return k if k is not None else self.ends.get(word[-self.width :], self.size - 1)


class SymbolMemo(dict):
    def __init__(self, symbols: Symbols, keep: int = 500_000):
        super().__init__()
        self.symbols, self.keep = symbols, keep

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.keep:
            self.clear()
        out = self[word] = self.symbols.of(word)
        return out


def count_bigrams(docs: DataFrame, symbols: Symbols, folds: int) -> np.ndarray:
    """Matrix of symbol bigrams over the training documents; the last row is the start, the last column the end."""
    size = symbols.size + 1
    shared = docs.sparkSession.sparkContext.broadcast(symbols)  # at most symbols + endings words
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = SymbolMemo(shared.value)
        total = np.zeros(size * size, np.int64)
        for b in it:
            pairs = []
            for i, t in zip(b.column(0).to_pylist(), binary(b.column(1)), strict=True):
                if not held_out(i, folds):
                    words = words_of(t, True)
                    s = np.empty(len(words) + 2, np.int64)
                    s[0] = s[-1] = size - 1
                    s[1:-1] = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                    pairs.append(s[:-1] * size + s[1:])
            if pairs:
                total += np.bincount(np.concatenate(pairs), minlength=size * size)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 100_000):
            part = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], schema=schema)

    sums = docs.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[sums.column("pair").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, rounds: int = 8) -> np.ndarray:
    """Class of each symbol. pairs: as from count_bigrams; start and end keep a class of their own, the last."""
    size = len(pairs) - 1
    k = min(classes, max(1, size))
    order = np.argsort(-(pairs.sum(axis=0)[:size] + pairs.sum(axis=1)[:size]), kind="stable")
    of = np.empty(size + 1, np.int64)
    of[order] = np.arange(size) % k
    of[size] = k
    member = np.zeros((size + 1, k + 1))
    member[np.arange(size + 1), of] = 1.0
    right, left = pairs @ member, member.T @ pairs  # symbol x class after it; class before it x symbol
    grid = member.T @ right
    for _ in range(rounds):
        moved = 0
        for w in order:
            a = of[w]
            r, c, self_n = right[w].copy(), left[:, w].copy(), pairs[w, w]
            if not r.any() and not c.any():
                continue
            r[a] -= self_n
            c[a] -= self_n
            g = grid.copy()
            g[a] -= r
            g[:, a] -= c
            g[a, a] -= self_n
            rows, cols = g.sum(axis=1), g.sum(axis=0)
            up = (_f(g[:k] + r) - _f(g[:k])).sum(axis=1) + (_f(g[:, :k] + c[:, None]) - _f(g[:, :k])).sum(axis=0)
            d = np.arange(k)
            corner = g[d, d]
            up += _f(corner + r[d] + c[d] + self_n) - _f(corner + r[d]) - _f(corner + c[d]) + _f(corner)
            nr, nc = r.sum() + self_n, c.sum() + self_n
            up -= _f(rows[:k] + nr) - _f(rows[:k]) + _f(cols[:k] + nc) - _f(cols[:k])
            b = int(np.argmax(up))
            if b != a and up[b] > up[a] + 1e-9:
                moved += 1
                of[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[a] -= pairs[w]
                left[b] += pairs[w]
                grid = g
                grid[b] += r
                grid[:, b] += c
                grid[b, b] += self_n
        if not moved:
            break
    return of


@dataclass
class Model:
    """What scoring needs, of bounded size."""

    symbols: Symbols
    of: np.ndarray  # class of each symbol
    trans: np.ndarray  # log10 P(class | class before)
    class_den: np.ndarray  # log10 of each class's total
    base_den: float
    head: dict[bytes, int]  # count of the most frequent words
    tokens: int
    ends: int


def _most_frequent(words: DataFrame, head: int) -> list[tuple[bytes, int]]:
    """At most `head` words by count: all whose count is above the largest one at which they would be more. The limit is
    found on how many words have each count, so no partition sends more than it has of these words."""
    held, least = 0, None
    for r in words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.col("n").desc()).limit(head).collect():
        if held + r["words"] > head:
            break
        held, least = held + r["words"], r["n"]
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["n"]) for r in words.where(F.col("n") >= least).select("word", "n").collect()), key=lambda x: (-x[1], x[0]))


def fit(docs: DataFrame, head: int = 200_000, symbols: int = 1000, endings: int = 500, classes: int = 48, folds: int = 5) -> tuple[Model, DataFrame]:
    """The model, and the table (word, n) of all counts."""
    counts = materialize(count_words(docs, folds), "words")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.max(F.when(F.octet_length("word") == 0, F.col("n"))).alias("ends")).first()
    n, v, ends = total["n"] or 0, total["v"] or 0, total["ends"] or 0
    words = counts.where("octet_length(word) > 0")
    top = _most_frequent(words, head)
    own = {w: i for i, (w, _) in enumerate(top[:symbols])}
    by_end = words.groupBy(F.expr("substring(word, greatest(1, length(word) - 2), 3)").alias("e")).agg(F.sum("n").alias("n"))
    ends_of = [bytes(r["e"]) for r in by_end.orderBy(F.col("n").desc(), "e").limit(endings).collect()]
    table = Symbols(own, {e: len(own) + i for i, e in enumerate(ends_of)})
    pairs = count_bigrams(docs, table, folds)
    of = exchange(pairs, classes)
    k = int(of[-1])
    grid = np.zeros((k + 1, k + 1))
    np.add.at(grid, (of[:, None].repeat(len(of), 1), of[None, :].repeat(len(of), 0)), pairs)
    trans = np.log10((grid + 0.1) / (grid.sum(axis=1, keepdims=True) + 0.1 * (k + 1)))
    shared = docs.sparkSession.sparkContext.broadcast((table, of))  # as bounded as the symbols
    schema = pa.schema([("c", pa.int64()), ("n", pa.int64()), ("v", pa.int64())])

    def classes_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        syms, cls = shared.value
        out = np.zeros((k + 1, 2), np.int64)
        for b in it:
            for w, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                i = cls[syms.of(w)]
                out[i] += c, 1
        yield from batches(((i, int(x), int(y)) for i, (x, y) in enumerate(out)), schema)

    size = np.zeros(k + 1)
    for r in words.mapInArrow(classes_of, "c long, n long, v long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        size[r["c"]] = r["n"] + 0.5 * (r["v"] + 1)
    size[k] = 1.0
    return Model(table, of, trans, np.log10(np.maximum(size, 0.5)), log10(n + 0.5 * (v + 1)), dict(top), n, ends), counts


_PARTS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("tail", pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())])))])


class Scorer:
    """Scores one text but for the words outside the head, which it lists."""

    def __init__(self, model: Model, keep: int = 500_000):
        self.m, self.keep = model, keep
        self.known: dict[bytes, tuple[int, float]] = {}
        self.end = log10(model.ends + 0.5)
        self.unseen = log10(0.5)

    def _learn(self, w: bytes) -> tuple[int, float]:
        n = self.m.head.get(w)
        out = self.known[w] = (int(self.m.of[self.m.symbols.of(w)]), -1.0 if n is None else log10(n + 0.5))
        return out

    def parts(self, text: bytes | None) -> tuple[int, int, float, float, list[dict]]:
        words = words_of(text, True)
        if len(self.known) + len(words) > self.keep:
            self.known.clear()
        known, learn, m = self.known, self._learn, self.m
        both = [known[w] if w in known else learn(w) for w in words]
        k = len(m.trans) - 1
        cls = np.empty(len(words) + 2, np.int64)
        cls[0] = cls[-1] = k
        cls[1:-1] = np.fromiter((c for c, _ in both), np.int64, len(words))
        own = np.fromiter((x for _, x in both), np.float64, len(words))
        inside = own >= 0.0
        tail = Counter(w for w, x in zip(words, own, strict=True) if x < 0.0)
        base = float(own[inside].sum()) + self.end
        score = float(own[inside].sum()) + float(m.trans[cls[:-1], cls[1:]].sum()) - float(m.class_den[cls[1:-1]].sum())
        n = len(words) + 1
        return n, int(inside.sum()) + (m.ends > 0), base - n * m.base_den, score, [{"word": w, "tf": c} for w, c in tail.items()]


def score(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; log10 probabilities."""
    rows = pick(docs, id_col, text_col).toDF("id", "text")
    model, counts = fit(rows, folds=folds, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the head of the vocabulary: bounded by `head`

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        scorer = Scorer(shared.value)

        def out() -> Iterator[tuple]:
            uid = TaskContext.get().partitionId() << 40
            for b in it:
                for i, t in zip(b.column(0).to_pylist(), binary(b.column(1)), strict=True):
                    yield uid, i, *scorer.parts(t)
                    uid += 1

        yield from batches(out(), _PARTS, 500)

    parts = materialize(rows.mapInArrow(run, "uid long, doc_id long, n_tokens long, n_known long, base double, score double, tail array<struct<word:binary,tf:int>>"), "scores")
    tail = parts.select("uid", F.explode("tail").alias("t")).select("uid", "t.word", "t.tf")
    n = F.coalesce("n", F.lit(0))
    found = tail.join(counts, "word", "left").groupBy("uid").agg(F.sum(F.col("tf") * F.log10(n + 0.5)).alias("more"), F.sum(F.when(n > 0, F.col("tf")).otherwise(0)).alias("hits"))
    all_ = parts.drop("tail").join(found, "uid", "left")
    more, hits = F.coalesce("more", F.lit(0.0)), F.coalesce("hits", F.lit(0))
    return all_.select(
        F.col("doc_id").alias(id_col),
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 1).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + hits).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
