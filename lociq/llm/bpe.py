"""BPE encoding and decoding by tree concatenation.

A text is halved again and again, wherever the cut falls, down to leaves of `leaf` bytes. All words of all leaves are
encoded in one parallel batch (each distinct one once for as long as it is remembered); then neighbours are joined, level
by level. White space always separates words of the vocabulary file's splitter, so the window around a join that must be
encoded anew grows to the white space on either side: the words beyond it are the same alone and joined.

A run without white space of more than `leaf` characters goes by the tree of its own characters: the leaves are encoded
in one batch, and each join is repaired: a window of tokens around it is encoded anew and grows until the tokens at its
rims are those which both sides already have there; the rest of both sides is kept. A BPE token sequence is right if each
two neighbours are, so equal rim tokens prove the whole.

Defined results: a null text counts as empty and has no tokens; special tokens in a text are found as the library does;
repeated rows each have their row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lociq.llm.text import batches, binary
from lociq.session import pick


#: The steps before the merges that PIECES does on lower-cased ASCII words.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Printable ASCII: one character each in the byte-level alphabet, and itself.
PLAIN = re.compile(rb"[!-~]+").fullmatch


@dataclass
class TreeBpe:
    """An encoder equal to Tokenizer.from_file(path) with add_special_tokens=False.

    leaf: bytes of a leaf of a text, and characters of the longest run that is encoded whole; window: tokens on either
    side of a join to begin with; keep: words remembered by each worker."""

    path: str
    leaf: int = 4096
    window: int = 16
    keep: int = 200_000
    joins: int = field(default=0, init=False)

    def __post_init__(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores; threads would wait for each other
        from tokenizers import Tokenizer, models

        self.whole = Tokenizer.from_file(self.path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.load(open(self.path, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        kw = {k: model[k] for k in ("unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback") if model.get(k)}
        self.inner = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, **kw))
        self.last = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, **kw, **({"end_of_word_suffix": self.suffix} if self.suffix else {})))
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.joined = spec.get("decoder") is None  # then decoding puts one space between tokens
        # What words encode to: their ids in decimal, and their tokens; the same of the pieces of ASCII words.
        self.ids: dict[bytes, str] = {}
        self.said: dict[bytes, str] = {}
        self.pieces: dict[str, tuple[str, str]] = {}
        self.split = PIECES.findall if spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == SPLITTER else None
        self.by_id = {v: k for k, v in self.whole.get_vocab(with_added_tokens=True).items()}

    # texts

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return [int(i) for _, ids, _ in self.encode_many([text.encode()]) for i in ids.split()]

    def leaves(self, text: bytes) -> list[bytes]:
        """The text in halves of halves, cut between characters, none larger than leaf."""
        cuts = [0, len(text)]
        while max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) > max(self.leaf, 8):
            new = cuts[:1]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > max(self.leaf, 8):
                    mid = (a + b) // 2
                    while text[mid] & 0xC0 == 0x80:  # within a character
                        mid -= 1
                    new.append(mid)
                new.append(b)
            cuts = new
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def join(self, left: tuple[bytes, list[bytes], bytes], right: tuple[bytes, list[bytes], bytes]) -> tuple[bytes, list[bytes], bytes]:
        """Two neighbours (first byte, words, last byte) as one: a word that the cut has split is whole again."""
        (a, x, b), (c, y, d) = left, right
        self.joins += 1
        if x and y and not b.isspace() and not c.isspace():
            x = [*x[:-1], x[-1] + y[0]] + y[1:]
        else:
            x = x + y
        return a, x, d

    def learn(self, words: set[bytes]) -> None:
        """Remember what words encode to; all that is remembered goes when it would exceed keep.

        Many ASCII words share few pieces (a word with its comma, with a capital): these are encoded once."""
        new = words.difference(self.ids)
        if len(self.ids) + len(new) > self.keep:
            self.ids.clear()
            self.said.clear()
            new = words
        cut, rest = [], []
        for w in new:
            t = w.decode()
            if self.split is None or len(t) > self.leaf or not PLAIN(w) or self.special.search(t):
                rest.append((w, t))
            else:
                cut.append((w, self.split(t.lower())))
        self._learn_pieces({p for _, x in cut for p in x})
        for w, x in cut:
            if len(x) == 1:
                self.ids[w], self.said[w] = self.pieces[x[0]]
            else:
                self.ids[w], self.said[w] = map(" ".join, zip(*map(self.pieces.__getitem__, x), strict=True))
        short = iter(self.whole.encode_batch_fast([t for _, t in rest if len(t) <= self.leaf], add_special_tokens=False))
        for w, t in rest:
            self.ids[w], self.said[w] = self._written(next(short).ids if len(t) <= self.leaf else self._run(t))

    def _learn_pieces(self, pieces: set[str]) -> None:
        new = pieces.difference(self.pieces)
        if len(self.pieces) + len(new) > self.keep:
            self.pieces.clear()
            new = pieces
        new = list(new)
        for p, e in zip(new, self.last.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.pieces[p] = self._written(e.ids)

    def _written(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), " ".join(map(self.by_id.__getitem__, ids)) if self.joined else ""

    # runs without white space

    def _run(self, run: str) -> list[int]:
        """A long run: special tokens are cut out, the rest is normalized and split, long words go by the tree."""
        out, at = [], 0
        for m in self.special.finditer(run):
            out += self._plain(run[at : m.start()])
            out.append(self.whole.token_to_id(m[0]))
            at = m.end()
        return out + self._plain(run[at:])

    def _plain(self, run: str) -> list[int]:
        if not run:
            return []
        norm = self.whole.normalizer.normalize_str(run) if self.whole.normalizer else run
        words = [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(norm)] if self.whole.pre_tokenizer else [norm]
        short = iter(self.last.encode_batch([w for w in words if len(w) <= self.leaf], add_special_tokens=False))
        return [i for w in words for i in (next(short).ids if len(w) <= self.leaf else self.encode_word(w))]

    def encode_word(self, word: str) -> list[int]:
        """The ids of one unsplit word (in the splitter's alphabet), by halves."""
        cuts = [0, len(word)]
        while max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) > self.leaf:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:], strict=False) if b - a > self.leaf)})
        spans = list(zip(cuts, cuts[1:], strict=False))
        done = [e.ids for e in self.inner.encode_batch([word[a:b] for a, b in spans[:-1]], add_special_tokens=False)]
        parts = [(a, b, ids) for (a, b), ids in zip(spans, [*done, self._piece(word, *spans[-1])], strict=True)]
        while len(parts) > 1:  # pairs of neighbours, level by level
            parts = [self._join(word, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0][2]

    def _piece(self, word: str, a: int, b: int) -> list[int]:
        """The ids of word[a:b]; only the end of the word takes the suffix."""
        return (self.last if b == len(word) else self.inner).encode_batch([word[a:b]], add_special_tokens=False)[0].ids

    def _length(self, i: int) -> int:
        token = self.by_id[i]
        return len(token) - (len(self.suffix) if self.suffix and token.endswith(self.suffix) else 0)

    def _join(self, word: str, left: tuple, right: tuple) -> tuple:
        (lo, cut, li), (_, hi, ri) = left, right
        self.joins += 1
        size = self.window
        while True:
            nl, nr = min(size, len(li)), min(size, len(ri))
            a = cut - sum(map(self._length, li[len(li) - nl :]))
            b = cut + sum(map(self._length, ri[:nr]))
            mid = self._piece(word, a, b)
            if (nl == len(li) or mid[0] == li[len(li) - nl]) and (nr == len(ri) or mid[-1] == ri[nr - 1]):
                return lo, hi, li[: len(li) - nl] + mid + ri[nr:]
            size *= 2

    # results

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids, skip_special_tokens=False)

    def encode_many(self, texts: list[bytes]) -> Iterator[tuple[int, str, str]]:
        """Of each UTF-8 text: number of tokens, the ids in decimal, and the decoded text."""
        trees = [[(x[:1], x.split(), x[-1:]) for x in self.leaves(t)] for t in texts]
        self.learn(set().union(*(words for parts in trees for _, words, _ in parts)))
        joined: set[bytes] = set()
        for i, parts in enumerate(trees):
            if len(parts) > 1:
                while len(parts) > 1:  # pairs of neighbours, level by level
                    parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
                joined.update(parts[0][1])
            trees[i] = parts[0][1]
        if not joined.issubset(self.ids):
            self.learn(set().union(*trees))
        for words in trees:
            ids = " ".join(map(self.ids.__getitem__, words))
            if "  " in ids or ids[:1] == " " or ids[-1:] == " ":  # words without tokens
                words = [w for w in words if self.ids[w]]
                ids = " ".join(map(self.ids.__getitem__, words))
            said = " ".join(map(self.said.__getitem__, words)) if self.joined else self.decode(list(map(int, ids.split())))
            yield ids.count(" ") + 1 if ids else 0, ids, said

    def digests(self, texts: list[bytes]) -> Iterator[tuple[int, str, str]]:
        """Of each UTF-8 text: number of tokens, SHA-256 of the ids in decimal, and of the decoded text."""
        for n, ids, said in self.encode_many(texts):
            yield n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()


_made: dict[tuple, TreeBpe] = {}


def encoder(path: str, leaf: int = 4096) -> TreeBpe:
    """One encoder for each worker process."""
    if (path, leaf) not in _made:
        _made[path, leaf] = TreeBpe(path, leaf)
    return _made[path, leaf]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, ids array<int>, carried columns) of every row. No shuffle: each task encodes what it reads."""
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    names = [f"carried{i}" for i in range(len(carry))]
    wide = pick(docs, id_col, text_col, *carry).toDF("id", "text", *names)
    types = "".join(f", {n} {wide.schema[n].dataType.simpleString()}" for n in names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, leaf)
        for b in it:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                said = bpe.encode_many([t or b"" for t in binary(part.column(1))])
                ids = pa.array([np.fromstring(x, np.int32, sep=" ") for _, x, _ in said], schema.types[1])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), ids, *part.columns[2:]], names=[*schema.names, *names])

    return wide.mapInArrow(run, "id long, ids array<int>" + types).toDF(id_col, "ids", *carry)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of token ids; a null list decodes to an empty text."""
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        yield from batches(((i, bpe.decode(x or [])) for b in it for i, x in zip(*(c.to_pylist() for c in b.columns), strict=True)), schema, 256)

    return pick(encoded, id_col, ids_col).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 4096) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the round trip of every row in one pass without a shuffle."""
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, leaf)
        for b in it:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                said = bpe.digests([t or b"" for t in binary(part.column(1))])
                yield from batches(((i, *x) for i, x in zip(part.column(0).to_pylist(), said, strict=True)), schema, 256)

    return pick(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
