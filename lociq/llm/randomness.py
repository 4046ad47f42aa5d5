"""Secrets in texts: fixed patterns, and a battery of randomness tests over what looks encoded.

One pass reads all texts. It finds the fixed patterns and every maximal run of encoding characters of LEAST or more that no
fixed pattern covers; of such a candidate it keeps what the tests need (sum of squared symbol counts, class switches,
serial correlation), in the smallest alphabet that holds it. The same pass counts characters and class switches of all
text: the model of ordinary text.

Tests of a candidate of n symbols in an alphabet of k:
 * chi-squared against a uniform alphabet. If random, its mean is k - 1; if ordinary text, mean and variance follow from n
   and the model's frequencies, so that a short candidate has to be more uniform than chance makes short words.
 * runs of character classes (lower, upper, digit, other), against the rates of both models.
 * serial correlation of successive symbols, which is about nothing if random.
A candidate is passed on if none of the three speaks against randomness (ALPHA, by Bonferroni). Chi-squared and runs
against ordinary text are joined by Fisher's method to one p-value. In each band of lengths the p-values of all candidates
of the corpus then go through Benjamini and Hochberg's procedure at level FDR, on counts by tenths of a decade.

What reaches the driver: one sum a model cell and one count a band and tenth of a decade, whatever the input.

Defined results: a null text is empty; a null doc_id keeps its row; repeated rows each have a row; an empty table gives an
empty result; other columns are not read. A candidate within a span of a fixed pattern is not reported again.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.text import batches, binary
from lociq.session import materialize, pick

# Patterns over texts whose A-Z are lowered (assign) or as they are, and the alphabets, smallest first.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{16,}")
SHORTEST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "random")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (
    _DIGITS + "abcdef",
    _DIGITS + "ABCDEF",
    _UPPER + "234567",
    _DIGITS + _LOWER,
    _DIGITS + _UPPER,
    _UPPER + _LOWER + _DIGITS,
    _UPPER + _LOWER + _DIGITS + "+/",
    _UPPER + _LOWER + _DIGITS + "-_",
)
CANDIDATE = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
LEAST = 20
BANDS = (24, 32, 48, 96)
ALPHA, FDR = 1e-3, 1e-2

#: Class of a byte: 0 none, 1 lower, 2 upper, 3 digit, 4 other.
CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((_LOWER, _UPPER, _DIGITS, "+/-_"), 1):
    CLASS[[ord(c) for c in _chars]] = _i
CODES = np.full((len(ALPHABETS), 256), -1, np.int16)
for _i, _chars in enumerate(ALPHABETS):
    CODES[_i, [ord(c) for c in _chars]] = np.arange(len(_chars))

_FOUND = pa.struct([("start", pa.int32()), ("kind", pa.int8()), ("end", pa.int32())])
_CANDIDATE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("alphabet", pa.int8()), ("n", pa.int32()), ("squares", pa.int64()), ("switches", pa.int32()), ("serial", pa.float64())])
_SCAN = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(_FOUND)), ("candidates", pa.list_(_CANDIDATE)), ("model", pa.list_(pa.int64()))])
_SCAN_SQL = "doc_id long, found array<struct<start:int,kind:byte,end:int>>, candidates array<struct<start:int,end:int,alphabet:byte,n:int,squares:long,switches:int,serial:double>>, model array<long>"


def alphabet_of(token: bytes) -> int | None:
    """The smallest alphabet that holds a token; none for a number or a mixture of two."""
    if token.isdigit():
        return None
    codes = np.frombuffer(token, np.uint8)
    return next((i for i in range(len(ALPHABETS)) if (CODES[i, codes] >= 0).all()), None)


def figures(token: bytes) -> tuple[int, int, int, int, float] | None:
    """alphabet, n, sum of squared counts, class switches, serial correlation of a token without its padding."""
    token = token.rstrip(b"=")
    which = alphabet_of(token)
    if which is None:
        return None
    raw = np.frombuffer(token, np.uint8)
    x = CODES[which, raw].astype(np.int64)
    kinds, d = CLASS[raw], x - x.mean()
    total = float(d @ d)
    serial = float(d[:-1] @ d[1:]) / total if total else 1.0
    return which, len(x), int((np.bincount(x) ** 2).sum()), int((kinds[1:] != kinds[:-1]).sum()), serial


def model_counts(buffer: np.ndarray) -> np.ndarray:
    """How often each byte occurs, and then how often bytes of each two classes follow each other."""
    kinds = CLASS[buffer]
    return np.concatenate([np.bincount(buffer, minlength=256), np.bincount(kinds[:-1] * np.uint8(5) + kinds[1:], minlength=25)])


def _points(text: bytes, offsets: list[int]) -> list[int]:
    """Byte offsets as code points."""
    if text.isascii():
        return offsets
    first = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(first)])
    return before[offsets].tolist()


def scan(texts: list[bytes]) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """Spans of fixed patterns and candidates of each text. No pattern goes beyond a line, so texts are read together."""
    joined = b"\n".join(texts)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)]).tolist()
    hits: dict[int, list[tuple[int, int, int]]] = {}

    def put(kind: int, a: int, b: int) -> None:
        at = bisect_right(starts, a) - 1
        hits.setdefault(at, []).append((a - starts[at], kind, b - starts[at]))

    for m in ASSIGN.finditer(joined.lower()):
        if m.end(1) - m.start(1) >= SHORTEST["assign"]:
            put(0, *m.span())
    for m in ACCESS.finditer(joined):
        if m.end() - m.start() >= SHORTEST["access"]:
            put(1, *m.span())
    for m in HEX.finditer(joined):
        put(2, *m.span())
    for m in CANDIDATE.finditer(joined):
        put(3, *m.span())
    for i, text in enumerate(texts):
        found = sorted(hits.get(i, ()))
        fixed = [x for x in found if x[1] < 3]
        left = [(a, b, f) for a, kind, b in found if kind == 3 and not any(s <= a and b <= e for s, _, e in fixed) and (f := figures(text[a:b])) is not None]
        if not found:
            yield [], []
            continue
        points = dict(zip(offsets := sorted({x for a, _, b in found for x in (a, b)}), _points(text, offsets), strict=True))
        yield [(points[a], kind, points[b]) for a, kind, b in fixed], [(points[a], points[b], *f) for a, b, f in left]


def _scanned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> what each text holds, and one row with the counts of all these texts."""
    model = np.zeros(281, np.int64)

    def rows() -> Iterator[tuple]:
        for b in it:
            texts = [t or b"" for t in binary(b.column(1))]
            model[:] += model_counts(np.frombuffer(b"\n".join(texts), np.uint8))
            for doc_id, (found, candidates) in zip(b.column(0).to_pylist(), scan(texts), strict=True):
                yield doc_id, [dict(zip(("start", "kind", "end"), x, strict=True)) for x in found], [dict(zip(_NAMES, x, strict=True)) for x in candidates], None
        yield None, None, None, model.tolist()

    yield from batches(rows(), _SCAN)


_NAMES = ("start", "end", "alphabet", "n", "squares", "switches", "serial")


def _upper(z: float) -> float:
    """Upper tail of the normal distribution, above zero."""
    return max(1e-300, 0.5 * math.erfc(z / math.sqrt(2)))


@dataclass
class TextModel:
    """Ordinary text: of each alphabet the power sums of symbol frequencies and the rate of class switches."""

    powers: list[tuple[float, float]]
    rates: list[float]
    classes: list[float]

    @staticmethod
    def of(counts: list[int]) -> TextModel:
        powers, rates, classes = [], [], []
        pairs = np.array(counts[256:], float).reshape(5, 5)
        for chars in ALPHABETS:
            p = np.array([counts[ord(c)] + 1.0 for c in chars])
            p /= p.sum()
            powers.append((float((p**2).sum()), float((p**3).sum())))
            has = sorted({int(CLASS[ord(c)]) for c in chars})
            among = pairs[np.ix_(has, has)] + 1.0
            rates.append(float(1 - np.trace(among) / among.sum()))
            share = np.bincount([CLASS[ord(c)] for c in chars]) / len(chars)
            classes.append(float(1 - (share**2).sum()))
        return TextModel(powers, rates, classes)

    def random(self, alphabet: int, n: int, squares: int, switches: int, serial: float) -> float:
        """p-value against a uniform alphabet, of the three tests together."""
        k = len(ALPHABETS[alphabet])
        chi, free = k * squares / n - n, k - 1
        z = ((max(chi, 0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
        s = self.classes[alphabet]
        runs = abs(switches - (n - 1) * s) / math.sqrt((n - 1) * s * (1 - s))
        return min(1.0, 3 * min(_upper(z), 2 * _upper(runs), 2 * _upper(abs(serial + 1 / n) * math.sqrt(n))))

    def text(self, alphabet: int, n: int, squares: int, switches: int) -> float:
        """p-value against ordinary text: as uniform, and as many class switches, as seen."""
        p2, p3 = self.powers[alphabet]
        mean = n + n * (n - 1) * p2
        var = 2 * n * (n - 1) * (p2 + 2 * (n - 2) * p3 - (2 * n - 3) * p2 * p2)
        chi = _upper((mean - squares) / math.sqrt(max(var, 1e-9)))
        s = self.rates[alphabet]
        runs = _upper((switches - 0.5 - (n - 1) * s) / math.sqrt((n - 1) * s * (1 - s)))
        half = -math.log(chi) - math.log(runs)
        return max(1e-300, math.exp(-half) * (1 + half))

    def decades(self, c: dict) -> float:
        """-log10 of a candidate's p-value against text; 0 if it is not random."""
        if self.random(*(c[n] for n in _NAMES[2:])) < ALPHA:
            return 0.0
        return -math.log10(self.text(*(c[n] for n in _NAMES[2:6])))


def thresholds(counts: dict[tuple[int, int], int], level: float = FDR) -> dict[int, float]:
    """Benjamini and Hochberg by band: the least -log10 p to report. counts: (band, tenth of a decade) -> candidates."""
    out = {}
    for band in {b for b, _ in counts}:
        steps = sorted(((t, n) for (b, t), n in counts.items() if b == band), reverse=True)
        m, seen = sum(n for _, n in steps), 0
        for t, n in steps:
            seen += n
            if 10 ** (-t / 10) <= level * seen / m:
                out[band] = t / 10
    return out


def _tenth(decades: float) -> int:
    return min(2999, math.floor(decades * 10))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every document."""
    spark = docs.sparkSession
    scanned = materialize(pick(docs, id_col, text_col).mapInArrow(_scanned, _SCAN_SQL), "secrets")
    sums = scanned.where("model IS NOT NULL").select(F.posexplode("model").alias("cell", "n")).groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = {r.cell: r.n for r in sums}
    model = TextModel.of([cells.get(i, 0) for i in range(281)])

    def judged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = {}
        for b in it:
            for c in (c for row in b.column(0).to_pylist() for c in row):
                key = bisect_right(BANDS, c["n"]), _tenth(model.decades(c))
                counts[key] = counts.get(key, 0) + 1
        yield from batches(((*k, n) for k, n in counts.items()), pa.schema([("band", pa.int32()), ("tenth", pa.int32()), ("n", pa.int64())]))

    rows = scanned.where("model IS NULL")
    found = rows.select("candidates").mapInArrow(judged, "band int, tenth int, n long").groupBy("band", "tenth").agg(F.sum("n").alias("n")).collect()
    least = thresholds({(r.band, r.tenth): r.n for r in found})

    def out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for b in it:
                for doc_id, found, candidates in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    base = [(x["start"], x["kind"], x["end"]) for x in found]
                    more = [(c["start"], 3, c["end"]) for c in candidates if _tenth(model.decades(c)) / 10 >= least.get(bisect_right(BANDS, c["n"]), math.inf)]
                    text = [",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in sorted(x)) for x in (base, base + more)]
                    yield (doc_id, *(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(text[0].encode()).hexdigest(), text[1], len(more))

        yield from batches(made(), pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_random", pa.int64())]))

    return rows.select("doc_id", "found", "candidates").mapInArrow(out, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
