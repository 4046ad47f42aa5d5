"""Secrets: fixed patterns by code points against plain Python, and the battery on planted random strings."""

import base64
import hashlib
import random
import re
import string

from lociq.llm import randomness

PATTERNS = {
    "assign": (r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    "access": (r"(AKIA[A-Z0-9]+)", 18),
    "hex": (r"([0-9a-f]+)", 16),
}


def plain(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, (p, least)) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if len(m[1]) >= least]
    return [x[2] for x in sorted(found)]


ODD = [
    None,
    "",
    "é" * 50 + " Token = 'abcdef123456' ünd AKIA" + "Q7" * 9,
    "tokentoken=secret: password:  abcdefghijklm",
    "AKIAAKIA12 AKIA" + "A" * 13 + " AKIA" + "A" * 14,
    "0123456789abcdef0 0123456789abcde 0123456789ABCDEF",
    "api_key=ABCDEFGHIJKL APIKEY\"  :  \"x.y-z=/+0123456 pa\nsecret=short token=0123456789abcdef0123456789abcdef",
    "ſecret=abcdefghijklmnop Key token:\nabcdefghijklmnop",
    "x" * 100_000 + " secret=" + "Ab3" * 40_000,
]


def test_fixed_patterns_by_code_points(spark):
    rng = random.Random(1)
    pieces = ["token=", "Secret : ", "AKIA", "é", "0123456789abcdef", "zz", " ", "\n", "'", "password", "=", "9f", "KKKKKKKKKKKKKK", "\x00"]
    texts = ODD + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    docs = spark.createDataFrame([(None if i == 0 else i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, TEXT string")
    got = {r.doc_id: r for r in randomness.find(docs).collect()}
    for i, t in enumerate(texts):
        r, want = got[i or None], plain(t)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in want) for k in PATTERNS]
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == want


def test_battery_finds_random_strings_and_leaves_words(spark):
    rng = random.Random(2)
    words = ["donaudampfschifffahrtsgesellschaft", "internationalization-of-everything", "com/example/library/internal/Helper", "thisIsAVeryLongCamelCaseIdentifierName", "a" * 40, "abcdefghijklmnopqrstuvwxyz0123456789", "------------------------", "SHOUTING_CONSTANT_NAME_OF_CODE", "01234567890123456789012345"]
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000))
    made = {
        "base64": [base64.b64encode(rng.randbytes(n)).decode() for n in (24, 30, 48, 66) for _ in range(10)],
        "base62": ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (24, 32, 40) for _ in range(10)],
        "base36": ["".join(rng.choice(string.ascii_lowercase + string.digits) for _ in range(n)) for n in (32, 40) for _ in range(10)],
    }
    secrets = [s for x in made.values() for s in x]
    rows = [(i, f"{prose[:200]} {s} end") for i, s in enumerate(secrets)] + [(1000 + i, f"so {w} end {prose}") for i, w in enumerate(words * 20)]
    got = {r.doc_id: r for r in randomness.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i].n_random for i in range(len(secrets))) >= 0.95 * len(secrets)
    assert all(got[1000 + i].n_random == 0 for i in range(len(words) * 20))
    at = prose[:200] + " "
    assert got[0].spans in ("", f"random:{len(at)}:{len(at) + len(secrets[0])}")


def test_no_rows(spark):
    assert randomness.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_false_discovery_control_is_that_of_sorted_p_values():
    rng = random.Random(4)
    p = [rng.random() for _ in range(500)] + [10 ** -rng.uniform(3, 9) for _ in range(40)]
    tenths = [randomness._tenth(-__import__("math").log10(x)) for x in p]
    counts = {(0, t): tenths.count(t) for t in set(tenths)}
    least = randomness.thresholds(counts)[0]
    rounded = sorted(10 ** (-t / 10) for t in tenths)
    limit = max(x for i, x in enumerate(rounded, 1) if x <= randomness.FDR * i / len(p))
    assert abs(10**-least - limit) < 1e-12
