"""The tree of the BPE encoder on whole texts."""

import random

import pytest

from lociq.llm import bpe
from lociq.llm.queries import vocabulary


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.mark.parametrize("leaf", [8, 64, 4096])
def test_texts_cut_anywhere(leaf):
    lib, tree, rng = library(), bpe.TreeBpe(vocabulary(), leaf=leaf), random.Random(3)
    for _ in range(30):
        text = "".join(rng.choice(["the ", "thing", " a\n", "é", "世界", "İ ", "'s", "!!\t", "9", "<|endoftext|>", " ", " ", "　"]) for _ in range(rng.choice([0, 3, 90, 3000])))
        assert tree.encode(text) == lib.encode(text, add_special_tokens=False).ids
    assert tree.joins


def test_documents_go_through_joins(spark):
    lib, tree = library(), bpe.TreeBpe(vocabulary())
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("text").collect():
        assert tree.encode(r["text"]) == lib.encode(r["text"], add_special_tokens=False).ids
    assert tree.joins > 10


def test_many_special_tokens_in_one_run():
    text = "<|endoftext|>" * 3000 + "ab" * 9000
    assert bpe.TreeBpe(vocabulary()).encode(text) == library().encode(text, add_special_tokens=False).ids


class Counting:
    """A tokenizer that counts the strings that it is given."""

    def __init__(self, inner):
        self.inner, self.n = inner, 0

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def encode_batch_fast(self, texts, **kw):
        self.n += len(texts)
        return self.inner.encode_batch_fast(texts, **kw)


def test_words_of_equal_pieces_are_encoded_once():
    tree, lib, rng = bpe.TreeBpe(vocabulary()), library(), random.Random(8)
    names = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(50)]
    text = " ".join(f"{a}{w}{b}" for w in names for w in (w, w.title(), w.upper()) for a in ("", "(", '"') for b in ("", ",", "'s", "7"))
    tree.whole, tree.last = Counting(tree.whole), Counting(tree.last)
    assert tree.encode(text) == lib.encode(text, add_special_tokens=False).ids
    assert tree.whole.n + tree.last.n < 2 * len(names)  # of 36 words a name


def test_pieces_of_printable_words_are_those_of_the_library():
    tree, lib, rng = bpe.TreeBpe(vocabulary()), library(), random.Random(9)
    assert tree.split is not None
    for _ in range(300):
        parts = ["'", "s", "S", "'RE", "'ll", "!", "_", "0", "42", "A", "bc", "~", "<|endoftext|>", "<|", "\x00", "\x7f", "é", "　", " ", "\t"]
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        (n, ids, said), e = next(tree.encode_many([text.encode()])), lib.encode(text, add_special_tokens=False)
        assert (n, ids, said) == (len(e.ids), " ".join(map(str, e.ids)), lib.decode(e.ids, skip_special_tokens=False)), text


def test_forgetting_changes_nothing():
    lib, rng = library(), random.Random(10)
    small, words = bpe.TreeBpe(vocabulary()), [f"w{i}x" for i in range(60)] + ["é", "　"]
    small.keep = 40
    for _ in range(8):
        texts = [" ".join(rng.choices(words, k=30)) for _ in range(3)]
        assert [x[1] for x in small.encode_many([t.encode() for t in texts])] == [" ".join(map(str, lib.encode(t, add_special_tokens=False).ids)) for t in texts]
