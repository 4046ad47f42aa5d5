"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lociq.llm import bpe, html, language, mixing, mtree, near, ngram_lm, quality, substring, warc
from lociq.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark):
    """Small texts of few words with near copies, repeats, null and empty texts, and columns that clash."""
    rng = random.Random(4)
    base = [[rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.choice([3, 9, 30, 70]))] for _ in range(12)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = f"q{rng.randrange(5)}"
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w), "en" if i % 2 else "fr", f"s{i % 3}", 0))
    rows += [(90, None, None, None, None), (91, "", "en", "", 0), (92, " \n", "en", "s0", 2), (93, "Aé" * 9000, "en", "s1", 18000), (None, "null id here", "en", "s1", 3)]
    df = spark.createDataFrame(rows, DOCS)
    return rows, df.withColumn("TEXT2", F.lit("x")).select("*", F.lit(1).alias("node"), F.lit("no").alias("Text")).repartition(3)


def words(text, lower=False):
    b = (text or "").encode()
    return (b.lower() if lower else b).split()


def test_bpe_equals_library(spark, corpus):
    from tokenizers import Tokenizer

    rows, df = corpus
    lib = Tokenizer.from_file(vocabulary())
    got = {r["doc_id"]: r for r in bpe.encode_digests(df, vocabulary(), leaf=64).collect()}
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        said = lib.decode(ids, skip_special_tokens=False)
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
    back = bpe.decode(bpe.encode(df, vocabulary()), vocabulary()).where("doc_id = 0").first()["text"]
    assert back == lib.decode(lib.encode(rows[0][1], add_special_tokens=False).ids, skip_special_tokens=False)


def test_bpe_tree_joins_are_exact():
    from tokenizers import Tokenizer

    lib, tree, rng = Tokenizer.from_file(vocabulary()), bpe.TreeBpe(vocabulary(), leaf=16, window=2), random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["the", "ing", "a", "é", "'s", "!!", "9", "<|endoftext|>"]) for _ in range(rng.choice([1, 40, 200])))
        assert tree.encode(text) == lib.encode(text, add_special_tokens=False).ids
    assert tree.joins


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_jaccard_components(corpus, k, num, den):
    rows, df = corpus
    sets = []
    for i, t, *_ in rows:
        w = words(t, True)
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and a < b and s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.jaccard_components(df, k, num, den).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets}


def brute_dedup(rows, size):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            if key in seen:
                gone[p : p + size] = [True] * size
            seen.add(key)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_substring_dedup_and_its_index(spark, corpus):
    rows, df = corpus
    assert {r["doc_id"]: tuple(r)[1:] for r in substring.dedup(df, size=5).collect()} == brute_dedup(rows, 5)
    path = substring.index_location(spark)
    first = substring.dedup(df.where("doc_id is null or doc_id < 40"), size=5, index_path=path).collect()
    then = substring.dedup(df.where("doc_id >= 40"), size=5, index=spark.read.parquet(path)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in first + then} == brute_dedup(rows, 5)


def test_quality_and_mixing_equal_their_twins(spark, corpus):
    rows, df = corpus
    more = rows + [(200 + i, t, "en", "s0", 0) for i, t in enumerate(["A b c. " * 30, "x | y | z | " * 30, "Go!! " * 40, "w w w w w w w w w " * 9, "It is so, and on.\nCookie notice\n" * 12])]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", more)
    d = spark.createDataFrame(more, DOCS)
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(map(tuple, quality.assess(d).collect()), key=key) == sorted(db.sql(quality.ORACLE).fetchall(), key=key)
    named = d.where("doc_id is not null")
    db.execute("DELETE FROM documents WHERE doc_id IS NULL")
    mixed = mixing.mix(named.select("doc_id", "source", "text")).drop("text")
    got = sorted(map(tuple, mixed.collect()), key=key)
    assert got == sorted(db.sql(mixing.ORACLE).fetchall(), key=key)
    assert all(r[5] <= r[2] < r[6] for r in got)  # within release and deadline: less than one block off


def test_html_keeps_the_article():
    weights = {"|p|": 2.0, "|h1|": 2.0, "nav|li|a": -3.0, "|div|": -2.0, "footer|footer|": -3.0}
    page = "<html><head><title>T x</title><script>a('<p>no</p>')</script></head><body><nav><ul><li><a>Home</a></li></ul></nav><h1>One &amp; two</h1><p>Some  <b>bold</b> text&nbsp;here.<div class='ad'>Buy now</div><p>More of it.</p><div class=comments><p>I say no</p></div><footer>(c) x</footer>"
    assert html.Page(page).text(weights) == "One & two\n\nSome bold text here.\n\nMore of it."
    assert html.Page("").text(weights) == ""


def test_warc_round_trip(spark):
    rows = [(1, "http://b.example/x", "<p>é"), (7, "http://a.example/", "<p>é"), (7, "http://a.example/", "<p>é"), (3, None, None), (4, "u v\n", ""), (None, "http://a.example/q", "WARC/1.1\r\n\r\nhi\r\n\r\n")]
    got = warc.captures(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(got) == len(rows)
    assert [(r["url_key"], r["captured"]) for r in got] == sorted((r["url_key"], r["captured"]) for r in got)
    by = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got)
    assert by == Counter([(1, 5, "revisit", 7), (7, 5, "response", None), (7, 5, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (None, 18, "response", None)])
    rng = random.Random(3)
    runs = [sorted((rng.randrange(9), k) for _ in range(rng.randrange(6))) for k in range(7)]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_top_k(spark):
    rows = [(i, [float(i % 3), 1.0, -0.5 * (i % 2)]) for i in range(200)] + [(500, None), (501, [float("nan"), 1.0]), (None, [1.0]), (502, [1.0, None]), (503, []), (520, [0.25, 3.0, 9.0, 4.0])]
    valid = [(i, mtree.integers(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in valid:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in valid if j != q)[:4]
            want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), every=20, k=4)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_class_lm(corpus):
    rows, df = corpus
    train = [t for i, t, *_ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c = Counter(w for t in train for w in [*words(t, True), b""])
    n, den = sum(c.values()), math.log10(sum(c.values()) + 0.5 * (len(c) + 1))
    for r in ngram_lm.score(df, head=10, symbols=6, endings=4, classes=3).collect():
        w = [*words(next(t for i, t, *_ in rows if i == r["doc_id"]), True), b""]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(c[x] + 0.5) - den for x in w))
        assert -1e6 < r["score"] < 0


def test_language_spans_match_the_full_recursion(spark):
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate([("the house and the ring there", "en"), ("das haus und der ring auf dem", "de")] * 20)] + [(99, None, "en", "s", 0), (98, "12 ..", None, "s", 0)], DOCS)
    got = {r["doc_id"]: r for r in language.predict(docs).collect()}
    assert got[0]["lang_pred"] == "en" and got[1]["lang_pred"] == "de" and got[99]["lang_pred"] == got[98]["lang_pred"] == "und" and got[99]["score"] == 0.0
    model = language.fit(docs.select("doc_id", "text", "lang"))
    model.switch = 2.0
    mixed = b"the house and the ring there das haus und der ring auf dem das"
    path, _ = model.spans(mixed)
    assert len(set(path.tolist())) == 2 and path[0] != path[-1]
    assert language.script_of("привет") != language.script_of("hello") == 0


def test_empty_tables(spark):
    d = spark.createDataFrame([], DOCS)
    for made in (bpe.encode_digests(d, vocabulary()), near.jaccard_components(d), substring.dedup(d), quality.assess(d), ngram_lm.score(d), language.predict(d), mixing.mix(d)):
        assert made.collect() == []
    assert warc.captures(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []
    assert mtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pipeline_keeps_columns_and_clean_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
    ids = {r["doc_id"] for r in now.select("doc_id").collect()}
    good = {r["doc_id"] for r in quality.assess(docs).where("kept").select("doc_id").collect()}
    assert ids <= good and len(ids) > 0.8 * len(good)
