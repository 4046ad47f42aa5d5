"""The scores of op9 and the predictions of op10 over all documents, against plain Python that shares no step with them
but what was learnt by search: the classes of words."""

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest

from lociq.llm import language, ngram_lm
from lociq.session import table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    d = table(spark, DATA, "documents").select("doc_id", "text", "lang")
    return d, [tuple(r) for r in d.collect()]


def crc(i):
    return zlib.crc32(str(i).encode())


def test_class_scores_equal_plain_counts(docs):
    df, rows = docs
    said = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for i, t, _ in rows}
    train = [w for i, w in said.items() if crc(i) % 5 != 1]
    count = Counter(x for w in train for x in w)
    ends, size, kinds = len(train), sum(count.values()) + len(train), len(count) + 1

    model, _ = ngram_lm.fit(df.select("doc_id", "text").toDF("id", "text"))
    own = sorted(count, key=lambda w: (-count[w], w))[:1000]
    assert set(model.symbols.words) == set(own)
    by_end = Counter()
    for w, n in count.items():
        by_end[w[-3:]] += n
    assert set(model.symbols.ends) == set(sorted(by_end, key=lambda e: (-by_end[e], e))[:500])
    number = {w: int(model.of[i]) for w, i in model.symbols.words.items()}
    ending = {e: int(model.of[i]) for e, i in model.symbols.ends.items()}
    other, edge = int(model.of[model.symbols.size - 1]), int(model.of[-1])
    assert edge == max([*number.values(), *ending.values(), other]) + 1 and len(number) == len(own)

    def cls(w):
        return number.get(w, ending.get(w[-3:], other))

    steps, out_of, mass, words_in = Counter(), Counter(), Counter(), Counter()
    for w in train:
        line = [edge, *map(cls, w), edge]
        steps.update(zip(line, line[1:]))
        out_of.update(line[:-1])
    for w, n in count.items():
        mass[cls(w)] += n
        words_in[cls(w)] += 1
    got = {r["doc_id"]: r for r in ngram_lm.score(df).collect()}
    assert got.keys() == said.keys()
    for i, w in said.items():
        line = [edge, *map(cls, w), edge]
        score = sum(math.log10((steps[p] + 0.1) / (out_of[p[0]] + 0.1 * (edge + 1))) for p in zip(line, line[1:]))
        score += sum(math.log10((count[x] + 0.5) / (mass[cls(x)] + 0.5 * (words_in[cls(x)] + 1))) for x in w)
        base = sum(math.log10((n + 0.5) / (size + 0.5 * (kinds + 1))) for n in [*(count[x] for x in w), ends])
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i) % 5 == 1, len(w) + 1, sum(count[x] > 0 for x in w) + 1, size)
        assert r["score"] == pytest.approx(score, rel=1e-9) and r["base_score"] == pytest.approx(base, rel=1e-9)


def test_languages_equal_a_plain_recursion(docs):
    df, rows = docs

    def letters(w):
        return "".join(c for c in w if unicodedata.category(c)[0] == "L")

    def grams(w):
        p = f"<{letters(w).lower()}>"
        return [zlib.crc32(p[i : i + 3].encode()) % 65536 for i in range(len(p) - 2)]

    def script(w):
        c = ord(letters(w)[0])
        return next((s for s, ranges in language.SCRIPTS.items() if any(a <= c <= b for a, b in ranges)), None)

    def words(t):
        return [w.decode() for w in (t or "").encode().split()]

    seen, scripts = defaultdict(Counter), defaultdict(Counter)
    for i, t, lang in rows:
        if t is not None and lang is not None and crc(i) % 3 != 1:
            for w in t.split():
                if letters(w):
                    seen[lang].update(grams(w))
                    scripts[lang][script(w)] += 1
    langs = sorted(seen)
    total = {g: sum(seen[g].values()) for g in langs}
    named = {s: {g for g in langs if scripts[g][s] > 0.01 * max(1, sum(n for k, n in scripts[g].items() if k))} for s in language.SCRIPTS}
    memo = {}

    def scores(w):
        if w not in memo:
            use = named.get(script(w), set()) if letters(w) else set()
            memo[w] = [sum(math.log((seen[g][x] + 0.1) / (total[g] + 0.1 * 65536)) for x in grams(w)) - (100 if use and g not in use else 0) if letters(w) else 0.0 for g in langs]
        return memo[w]

    got = {r["doc_id"]: r for r in language.predict(df).collect()}
    right = Counter()
    for i, t, lang in rows:
        ws = words(t)
        size = [len(letters(w)) for w in ws]
        r = got[i]
        if not sum(size):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        best, back = scores(ws[0]), []
        for w in ws[1:]:
            top = max(range(len(langs)), key=lambda k: (best[k], -k))
            back.append([k if best[k] >= best[top] - 8 else top for k in range(len(langs))])
            best = [max(best[k], best[top] - 8) + s for k, s in enumerate(scores(w))]
        at = max(range(len(langs)), key=lambda k: (best[k], -k))
        path = [at]
        for step in reversed(back):
            path.append(step[path[-1]])
        share = Counter()
        for k, n in zip(reversed(path), size, strict=True):
            share[k] += n
        win = max(range(len(langs)), key=lambda k: (share[k], -k))
        assert (r["held_out"], r["lang_pred"]) == (crc(i) % 3 == 1, langs[win]), i
        assert r["score"] == pytest.approx(share[win] / sum(size), abs=1e-9)
        if r["held_out"] and lang is not None:
            right[r["lang_pred"] == lang] += 1
    assert right[True] >= 0.95 * right.total()
