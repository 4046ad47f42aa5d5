"""Words, word hashes and packed integer columns that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def words_of(text: bytes | None, lower: bool) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a UTF-8 text: what bytes.split() separates; lower() touches A-Z alone."""
    if not text:
        return []
    return (text.lower() if lower else text).split()


class WordIds(dict):
    """64-bit ids of words, kept for as long as they fit; ids do not depend on what is kept."""

    def __init__(self, seed: int = 0, keep: int = 150_000):
        super().__init__()
        self.seed, self.keep = seed, keep

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.keep:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit integers."""
    x = (x ^ (x >> U(30))) * _B
    x = (x ^ (x >> U(27))) * _C
    return x ^ (x >> U(31))


def windows(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive ids, by doubling."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, have, power, span = None, 0, ids, 1
    while True:
        if k & span:
            out = power[:n] if out is None else mix(out * _A + power[have : have + n] + U(have))
            have += span
        if have == k:
            return out
        power = mix(power[:-span] * _A + power[span:] + U(span))
        span *= 2


def shingle_set(ids: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, the whole sequence as one."""
    if len(ids) >= k:
        return np.unique(windows(ids, k))
    if not len(ids):
        return np.zeros(0, U)
    return mix(windows(ids, len(ids)) + U(len(ids)))


def binary(column: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


_zip, _unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes of the least width, compressed."""
    values = np.ascontiguousarray(values, U)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + _zip.compress(planes)


def unpack(blob: bytes) -> np.ndarray:
    width, planes = blob[0], np.frombuffer(_unzip.decompress(blob[1:]), np.uint8)
    n = len(planes) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.reshape(width, n).T
    return out.view(U).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers by their differences."""
    values = np.ascontiguousarray(values).view(U)
    return pack(np.diff(values, prepend=U(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=U)


def pack_signed(values: np.ndarray) -> bytes:
    """Signed integers by zigzagged differences: slowly changing columns shrink to almost nothing."""
    d = np.diff(np.asarray(values, np.int64), prepend=np.int64(0))
    return pack(((d << np.int64(1)) ^ (d >> np.int64(63))).view(U))


def unpack_signed(blob: bytes) -> np.ndarray:
    z = unpack(blob)
    d = (z >> U(1)).view(np.int64) ^ -(z & U(1)).view(np.int64)
    return np.cumsum(d, dtype=np.int64)


def slices(keys: np.ndarray, parts: int) -> np.ndarray:
    """Borders of parts equal ranges of the 64-bit space in sorted keys."""
    return np.searchsorted(keys, np.array([(p << 64) // parts for p in range(1, parts)], U), "left")


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Record batches of row tuples."""
    kept: list[tuple] = []
    for r in rows:
        kept.append(r)
        if len(kept) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types, strict=True)], schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types, strict=True)], schema=schema)
