"""Language identification: scripts narrow the candidates, Viterbi labels spans.

Each word scores for each language by its letter trigrams (naive Bayes); languages that are not written in the word's
script drop out. The best sequence of languages under a penalty for each switch labels the spans of a text, so
mixed texts are seen as such. The prediction is the language of most letters; its score is that share.

A text whose best single language cannot be beaten over any stretch by more than the penalty has one span; that is found
by a running minimum, and only other texts need the full recursion. Both give the same labels.

The model is fitted on about `per_lang` labelled documents of each language (a share by hashed id), whole texts,
never on held-out ones; what is kept of them is a table of 65,536 hashed trigrams a language.

Defined results: null texts and texts without letters are `und` with score 0; a null id counts as an empty text of
digits for the fold; without any labelled document everything is `und`; ties go to the alphabetically first language;
repeated rows each have their row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.text import batches, binary
from lociq.session import pick

BUCKETS = 1 << 16
# Code point ranges of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
_NAMES = list(SCRIPTS)
_LETTER = regex.compile(r"\p{L}")


def script_of(word: str) -> int:
    """Number of the script of the word's first letter, or -1."""
    m = _LETTER.search(word)
    if m:
        c = ord(m[0])
        for k, ranges in enumerate(SCRIPTS.values()):
            if any(a <= c <= b for a, b in ranges):
                return k
    return -1


def letters(word: str) -> str:
    return "".join(_LETTER.findall(word)).lower()


def trigrams(word: str) -> list[int]:
    return trigrams_of(f"<{word}>")


def trigrams_of(padded: str) -> list[int]:
    return [zlib.crc32(padded[i : i + 3].encode()) & (BUCKETS - 1) for i in range(len(padded) - 2)]


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # trigram bucket x language
    scripts: np.ndarray  # script x language: may be written so
    switch: float = 8.0
    keep: int = 300_000
    known: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.rows = np.zeros((1024, len(self.langs)), np.float32)
        self.sizes = np.zeros(1024, np.int64)
        # By script, and a last row for none: what a language loses that is not written so.
        named = np.vstack((self.scripts, np.ones_like(self.scripts[:1])))
        self.loss = np.where(named | ~named.any(axis=1, keepdims=True), 0, 100).astype(np.float32)
        self.first: dict[str, int] = {}
        self.grams: dict[int, int] = {}

    def learn(self, words: set[bytes]) -> None:
        """Score words not known yet, all at once; what is known goes when it would exceed keep."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.keep:
            self.known.clear()
            new = list(words)
        if not new:
            return
        at, end = len(self.known), len(self.known) + len(new)
        if end > len(self.sizes):
            more = max(end, 2 * len(self.sizes)) - len(self.sizes)
            self.rows = np.concatenate((self.rows, np.zeros((more, len(self.langs)), np.float32)))
            self.sizes = np.concatenate((self.sizes, np.zeros(more, np.int64)))
        self.rows[at:end], self.sizes[at:end] = self._score([w.decode() for w in new])
        self.known.update(zip(new, range(at, end), strict=True))

    def _score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities by language, and letters, of words."""
        said = [t.lower() if t.isalpha() else letters(t) for t in texts]
        size = np.fromiter(map(len, said), np.int64, len(said))
        rows, has = np.zeros((len(said), len(self.langs)), np.float32), np.flatnonzero(size)
        if len(has):
            chars = np.frombuffer("".join(f"<{w}>" for w in said if w).encode("utf-32-le"), np.uint32).astype(np.int64)
            ends = np.cumsum(size[has] + 2)
            inside = np.ones(len(chars), bool)
            inside[ends - 1] = inside[ends - 2] = False  # no trigram starts at a word's last two signs
            i = np.flatnonzero(inside)
            found, back = np.unique(chars[i] | chars[i + 1] << 21 | chars[i + 2] << 42, return_inverse=True)
            buckets = np.fromiter(map(self._bucket, found.tolist()), np.int64, len(found))
            starts = np.concatenate(([0], np.cumsum(size[has])[:-1]))
            rows[has] = np.add.reduceat(self.logp[buckets[back]], starts, axis=0)
            rows[has] -= self.loss[[self._script(texts[j]) for j in has.tolist()]]
        return rows, size

    def _bucket(self, gram: int) -> int:
        out = self.grams.get(gram)
        if out is None:
            if len(self.grams) >= self.keep:
                self.grams.clear()
            mask = (1 << 21) - 1
            (out,) = trigrams_of("".join(chr(gram >> k & mask) for k in (0, 21, 42)))
            self.grams[gram] = out
        return out

    def _script(self, word: str) -> int:
        out = self.first.get(word[0])
        if out is None:
            out = script_of(word)
            if word[0].isalpha():  # then the first sign alone decides; there are as many as letters
                self.first[word[0]] = out
        return out

    def spans(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """The language number of each word, and its letters."""
        words = (text or b"").split()
        self.learn(set(words))
        return self._spans(words)

    def _spans(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        e, size = self.rows[at].astype(np.float64), self.sizes[at]
        if not len(words) or not size.any():
            return np.zeros(len(words), np.int64), size
        one = int(np.argmax(e.sum(axis=0)))
        gain = np.cumsum(e - e[:, [one]], axis=0)
        low = np.minimum.accumulate(np.vstack((np.zeros((1, gain.shape[1])), gain[:-1])), axis=0)
        # A path that visits this language switches at least once for each stretch without it; one that never does
        # switches once less than it has stretches, so two stretches of over half a switch could pay.
        if (gain - low).max() < self.switch / 2:
            return np.full(len(words), one), size
        return self._viterbi(e), size

    def _viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best path; plain floats, as there are few languages. One step back a word and language is kept."""
        n, k = e.shape
        back, total = array("B" if k < 256 else "L", range(k)), e[0].tolist()
        for lo in range(1, n, 1 << 16):
            for row in e[lo : lo + (1 << 16)].tolist():
                best = max(total)
                moved, top = best - self.switch, total.index(best)
                back.extend([i if x >= moved else top for i, x in enumerate(total)])
                total = [(x if x >= moved else moved) + y for x, y in zip(total, row, strict=True)]
        out, at = np.zeros(n, np.int64), total.index(max(total))
        out[-1] = at
        for t in range(n - 1, 0, -1):
            at = back[t * k + at]
            out[t - 1] = at
        return out

    def predict_many(self, texts: list[bytes | None]) -> Iterator[tuple[str, float]]:
        """Of each text: its language and the share of its letters."""
        split = [(t or b"").split() for t in texts]
        self.learn(set().union(*split))
        for words in split:
            path, size = self._spans(words)
            total = int(size.sum())
            if not total:
                yield "und", 0.0
                continue
            share = np.bincount(path, size, len(self.langs))
            best = int(np.argmax(share))
            yield self.langs[best], float(share[best] / total)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        return next(self.predict_many([text]))


def fold(doc_id: int | None, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def fit(docs: DataFrame, per_lang: int = 1500, folds: int = 3) -> Model:
    """The model of docs(doc_id, text, lang), from about per_lang labelled documents of each language, chosen by hashed id."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds != 1))
    # A share of each language by hashed id: no row of text or key meets the others of its language in one task.
    share = labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_lang)) / F.count("*")).alias("share"))
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.join(F.broadcast(share), "lang").where(hashed < F.col("share")).select("lang", "text")  # one row a language
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in it:
            by: dict[str, Counter] = {}
            for lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by.setdefault(lang, Counter()).update(text.split())
            for lang, words in by.items():
                table = seen.setdefault(lang, np.zeros(BUCKETS + len(_NAMES), np.int64))
                for w, n in words.items():
                    if said := letters(w):
                        np.add.at(table, trigrams(said), n)
                        if (s := script_of(w)) >= 0:
                            table[BUCKETS + s] += n
        yield from batches(((lang, int(k), int(t[k])) for lang, t in seen.items() for k in np.flatnonzero(t)), schema, 20000)

    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x 65,550 cells at most
    langs = sorted(set(sums.column("lang").to_pylist()))
    table = np.zeros((BUCKETS + len(_NAMES), max(1, len(langs))))
    for lang, bucket, n in zip(*(c.to_pylist() for c in sums.columns), strict=True):
        table[bucket, langs.index(lang)] = n
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    logp = np.log((grams + 0.1) / (grams.sum(axis=0) + 0.1 * BUCKETS)).astype(np.float32)
    return Model(langs or ["und"], logp, scripts > 0.01 * np.maximum(1, scripts.sum(axis=0)))


def predict(docs: DataFrame, model: Model | None = None, folds: int = 3, per_lang: int = 1500) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    rows = pick(docs, "doc_id", "text", "lang")
    model = fit(rows, per_lang, folds) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp, model.scripts, model.switch))  # a few MB whatever the input
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model(*shared.value)

        def out() -> Iterator[tuple]:
            for b in it:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    said = mine.predict_many(binary(part.column(1)))
                    yield from ((i, fold(i, folds) == 1, *x) for i, x in zip(part.column(0).to_pylist(), said, strict=True))

        yield from batches(out(), schema)

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
