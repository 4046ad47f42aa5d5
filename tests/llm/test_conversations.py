"""Trie and repair of conversations against brute force, and the cases that tables may hold."""

import hashlib
import heapq
import itertools
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from lociq.llm import repair, trie

SCHEMA = "conv_id long, turn long, role string, text string, Turn string"


def brute_trie(paths):
    """paths: conv_id -> list of (key, words)."""
    nodes = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(nodes[q]) - 1) * (q[-1][1] if q else 0) for q in below)
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(p))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("ranges", [1, 5, 16])
def test_trie_equals_brute_force_over_ranges(spark, ranges):
    rng = random.Random(ranges)
    paths = {c: [(rng.choice("ab"), w) for w in [rng.randint(1, 2) for _ in range(rng.choice([0, 1, 2, 2, 3, 6]))]] for c in range(-20, 60)}
    paths |= {c: [("x", 1), ("y", 2), ("z", 3)] for c in range(100, 140)}  # a group of copies that several ranges share
    rows = [(c, b"".join(hashlib.md5(repr(t).encode()).digest() for t in turns), [w for _, w in turns]) for c, turns in paths.items()]
    got = trie.trie(spark.createDataFrame(rows, "conv_id long, path binary, words array<int>"), ranges).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_trie(paths)


def test_ranges_cut_groups_of_copies():
    copies = [(b"a" * 16, i) for i in range(100)]
    assert len(trie.separators(copies, 10)) == 9
    far = [(bytes([i]) * 64, i) for i in range(100)]
    assert {len(p) for p, _ in trie.separators(far, 10)} == {16}


def test_trie_rebuilds_and_takes_odd_rows(spark):
    rows = [(None, 0, "user", "lost", "x"), (7, None, None, "a  b", "x"), (7, 3, "user", None, "x"), (7, 3, "user", None, "x"), (27, 1, "", "", "x")]
    got = trie.trie(trie.rebuilt(spark.createDataFrame(rows, SCHEMA)), 4)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    import zlib

    own = {7: ["0:a  b", "4:user", "4:user"], 27: ["0:"]}
    left = {c: t[zlib.crc32(str(c).encode()) % 4 :] for c, t in own.items()}  # no conversation 0 or 20
    assert {(r.conv_id, r.depth) for r in got.collect()} == {(7, 0)} | {(c, d + 1) for c, t in left.items() for d in range(len(t))}
    assert trie.trie(trie.rebuilt(spark.createDataFrame([], SCHEMA)), 4).count() == 0


def brute_audit(rows):
    """Cheapest edits by best-first search over whole audits. rows: initial, must go, truncated."""
    queue = [(0, "", 0, "", ())]
    while True:
        cost, audit, i, out, _ = heapq.heappop(queue)
        if i == len(rows) and (not out or out.removeprefix("s") and not out.removeprefix("s").replace("ua", "")):
            return cost, audit
        want = "a" if out.endswith("u") else "u"
        if len(out) < 2 * len(rows) + 3:
            heapq.heappush(queue, (cost + 3, audit + "I", i, out + want, ()))
        if i < len(rows):
            initial, must_go, cut = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, out, ()))
            if not must_go:
                heapq.heappush(queue, (cost + 3 + 3 * cut, audit + "R", i + 1, out + want, ()))
                if initial == want or initial == "s" and not out:
                    heapq.heappush(queue, (cost + 3 * cut, audit + "K", i + 1, out + initial, ()))


def test_parse_equals_best_first_search():
    kinds = [(i, m, c) for i in ("s", "u", "a", "x") for m, c in ((False, False), (False, True), (True, False))]
    rng = random.Random(3)
    cases = [list(x) for n in (0, 1, 2) for x in itertools.product(kinds, repeat=n)] + [[rng.choice(kinds) for _ in range(rng.randint(3, 6))] for _ in range(300)]
    chart = repair.Chart()
    for rows in cases:
        parse = chart.start()
        for r in rows:
            parse.add(*r)
        assert parse.repair() == brute_audit(rows), rows


def test_long_conversations_take_few_columns():
    rng = random.Random(5)
    chart = repair.Chart()
    parse = chart.start()
    for _ in range(200_000):
        parse.add(rng.choice("suax"), rng.random() < 0.1, rng.random() < 0.3)
    cost, audit = parse.repair()
    assert len(audit) >= 200_000 and cost > 0 and len({c for c, _ in chart.steps}) < 500


def test_repair_takes_odd_rows(spark):
    rows = [(None, None, None, None, "x"), (5, None, "user", "Hi.", "x"), (5, 2, "tool", "Ü!", "x"), (5, 2, "tool", "Ü!", "x"), (5, 9, "assistant", "so  ", "x")]
    got = {r.conv_id: r for r in repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {None, 5}
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    # All rows of a conversation dropped: found by its key.
    import zlib

    c = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    r = repair.repair(spark.createDataFrame([(c, 0, "user", "Hi.", "x")], SCHEMA)).collect()[0]
    assert tuple(r) == (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_repaired_text_follows_the_audit():
    made = repair.Repaired("KIRDKI")
    for role, text in (("user", "a"), ("user", "b"), ("tool", "c"), ("assistant", "d")):
        made.add(role, text)
    # After the first turn an answer is inserted, b goes as user, c is deleted, d answers; the last insert asks.
    assert made.digest() == hashlib.sha256(b"user:a\nassistant:\nuser:b\nassistant:d\nuser:").hexdigest()


def test_rows_of_no_conversation_are_kept_apart():
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in (([None, 1], pa.int64()), ([0, 0], pa.int64()), ([False, False], pa.bool_()), (["a", "b"], pa.string()), (["u", "u"], pa.string()), ([False, False], pa.bool_()), ([False, False], pa.bool_()), ([False, False], pa.bool_()))], names=["conv_id", "turn", "dropped", "dg", "initial", "blank", "cut", "again"])
    out = pa.Table.from_batches(repair._parse(iter([batch]))).to_pylist()
    assert [(r["conv_id"], r["audit"], r["cost"]) for r in out] == [(None, "KI", 3), (1, "KI", 3)]
