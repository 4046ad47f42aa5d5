"""Repair of damaged conversations by error-correcting Earley parsing.

The grammar of role initials is left-linear, so every chart item starts at the beginning of the conversation and a column
holds one item a symbol: `Open` (nothing yet), `Sys`, `Half` (a user turn waits), `Full`. Besides keeping a row, its
error productions delete a row, give it another role or insert a turn of empty text, each at its weight. An item retains
the least (cost, audit); of the completed chart the cheapest accepted item is read backwards and yields the repair.

Audits of one column never are prefixes of each other (each ends with the edit of the same row, and the audit decides the
symbol), so an item needs its rank among them and no string. A column without its least cost is one of a few hundred; a
step from it is worked out once and then looked up, so a row costs one look-up and one reference.

Order of work: light rows (digest, initial, faults) are dealt by conversation and parsed in turn order; then each audit
meets the texts of its conversation in the same order, and the repaired text is hashed as it streams by. A SHA-256 is
sequential, so a conversation is one task's work by contract; no text is held, only one reference a row.

Defined results: a null role, text or turn counts as one space (in the damage key too); a null conv_id is a conversation
of its own; null turns come first; rows of one turn are ordered by the digest of role and text; repeated rows are
duplicates; an empty table gives an empty result; other columns are not read. Roles other than system, user and assistant
go by their first character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.text import batches
from lociq.session import pick

# Fixed values of the grammar and its weights.
START, ACCEPTED = "Open", ("Open", "Full")
#: symbol <- symbol before it, terminal.
PRODUCTIONS = (("Sys", "Open", "s"), ("Half", "Open", "u"), ("Half", "Sys", "u"), ("Half", "Full", "u"), ("Full", "Half", "a"))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: An item that costs more than the cheapest by more than this is beaten whatever follows: the cheapest can delete a system
#: turn that the other keeps (4) and insert a turn to wait for the same one (3), or insert a first pair (6).
BEATEN = DELETE + 2 * INSERT
FAULTS = 20
SPACE = " \\t\\n\\u000B\\f\\r"


def _inserted() -> dict[str, list[tuple[str, int]]]:
    """Symbol -> symbols that inserted turns lead to, with their least number."""
    out = {}
    for first in {x for lhs, left, _ in PRODUCTIONS for x in (lhs, left)}:
        seen, edge, k = {first: 0}, [first], 0
        while edge:
            k += 1
            edge = [lhs for lhs, left, t in PRODUCTIONS if left in edge and t in ROLES and lhs not in seen]
            seen |= dict.fromkeys(edge, k)
        out[first] = sorted(seen.items())
    return out


INSERTED = _inserted()

#: A column: (symbol, cost above the least, rank of the audit), by symbol.
Column_ = tuple[tuple[str, int, int], ...]


class Chart:
    """Steps between columns, worked out once each."""

    def __init__(self) -> None:
        self.first: Column_ = ((START, 0, 0),)
        self.steps: dict[tuple[Column_, tuple[str, bool, bool]], tuple[Column_, int, dict[str, tuple[str, str]]]] = {}

    def step(self, column: Column_, row: tuple[str, bool, bool]) -> tuple[Column_, int, dict[str, tuple[str, str]]]:
        """row: initial, must it go, is it truncated -> next column, its least cost above this one's, and for each symbol the item before and the edits from there."""
        if found := self.steps.get((column, row)):
            return found
        initial, must_go, cut = row
        best: dict[str, tuple[int, int, str, str]] = {}

        def offer(symbol: str, *item: int | str) -> None:
            if symbol not in best or item < best[symbol]:
                best[symbol] = item

        for symbol, cost, rank in column:
            for at, k in INSERTED[symbol]:
                spent, edits = cost + INSERT * k, "I" * k
                offer(at, spent + DELETE, rank, edits + "D", symbol)
                if must_go:
                    continue
                for lhs, left, terminal in PRODUCTIONS:
                    if left == at and terminal == initial:
                        offer(lhs, spent + TRUNCATED * cut, rank, edits + "K", symbol)
                    if left == at and terminal in ROLES:
                        offer(lhs, spent + REROLE + TRUNCATED * cut, rank, edits + "R", symbol)
        least = min(x[0] for x in best.values())
        best = {s: x for s, x in best.items() if x[0] <= least + BEATEN}
        order = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        out = tuple((s, best[s][0] - least, order[s]) for s in sorted(best)), least, {s: (best[s][3], best[s][2]) for s in best}
        self.steps[column, row] = out
        return out

    def start(self) -> Parse:
        return Parse(self)


class Parse:
    """The chart of one conversation."""

    def __init__(self, chart: Chart):
        self.chart, self.column, self.cost = chart, chart.first, 0
        self.back: list[dict[str, tuple[str, str]]] = []

    def add(self, initial: str, must_go: bool, cut: bool) -> None:
        self.column, more, back = self.chart.step(self.column, (initial if initial in ("s", "u", "a") else "", must_go, cut))
        self.cost += more
        self.back.append(back)

    def repair(self) -> tuple[int, str]:
        """The least cost and, of the audits that have it, the least by ASCII."""
        ends = ((cost + INSERT * k, rank, "I" * k, symbol) for symbol, cost, rank in self.column for at, k in INSERTED[symbol] if at in ACCEPTED and (at != START or not k))
        cost, _, last, symbol = min(ends)
        edits = [last]
        for back in reversed(self.back):
            symbol, edit = back[symbol]
            edits.append(edit)
        return self.cost + cost, "".join(reversed(edits))


class Repaired:
    """Applies an audit to the rows of its conversation and hashes the result."""

    def __init__(self, audit: str):
        self.audit, self.at, self.role, self.lines, self.hash = audit, 0, "u", 0, hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def _given(self, text: str) -> None:
        self._line(ROLES[self.role], text)
        self.role = "a" if self.role == "u" else "u"

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._given("")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self._given(text)
        elif edit == "K":
            self._line(role, text)
            self.role = {"u": "a", "a": "u"}.get(role[:1], "u")

    def digest(self) -> str:
        self._insert()
        return self.hash.hexdigest()


def fault(conv_id: Column, turn: Column) -> Column:
    """The damage that a row gets."""
    key = F.concat(F.coalesce(conv_id.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    return F.crc32(key.cast("binary")) % FAULTS


def damage(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: the rows after damage; those that it drops are marked, so that no conversation is lost."""
    d = pick(convs, "conv_id", "turn", "role", "text").withColumn("_f", fault(F.col("conv_id"), F.col("turn")))
    text, f = F.coalesce("text", F.lit(" ")), F.col("_f")
    return d.select(
        "conv_id",
        "turn",
        F.when(f == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(f == 1, "").when(f == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (f == 0).alias("dropped"),
        F.explode(F.when(f == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _digest() -> Column:
    return F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))


def light(rows: DataFrame) -> DataFrame:
    """The rows of a parse, without their texts: digest, initial, blank, truncated, and whether role and text came before."""
    last = F.right(F.expr(f"trim(TRAILING '{SPACE}' FROM text)"), F.lit(1))
    out = rows.select("conv_id", "turn", "dropped", _digest().alias("dg"), F.left("role", F.lit(1)).alias("initial"), last.alias("last"))
    slim = out.select("conv_id", "turn", "dropped", "dg", "initial", (F.col("last") == "").alias("blank"), (~F.col("last").isin(".", "!", "?")).alias("cut"))
    # One exchange: all that follows is clustered by conversation.
    return slim.repartition("conv_id").selectExpr("*", "row_number() OVER (PARTITION BY conv_id, dropped, dg ORDER BY turn NULLS FIRST) > 1 AS again").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "dg", "again")


_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_PARSED = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
_PARSED_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Light rows in turn order -> one row a conversation."""
    chart = Chart()

    def rows() -> Iterator[tuple]:
        now: object = it  # no conversation
        for b in it:
            for conv_id, turn, dropped, _, initial, blank, cut, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if conv_id != now or now is it:
                    if now is not it:
                        yield done()
                    now, parse, low, high, distinct, before = conv_id, chart.start(), None, None, 0, None
                    counts = [0, 0, 0, 0]

                    def done() -> tuple:
                        return (now, high - low + 1 - distinct if distinct else 0, *counts, *parse.repair())

                if dropped:
                    continue
                if turn is not None and turn != high:
                    low, high, distinct = turn if low is None else low, turn, distinct + 1
                counts[0] += blank
                counts[1] += again and not blank
                counts[2] += cut and not (blank or again)
                if before is not None:
                    counts[3] += (before, initial) not in _LEGAL
                before = initial
                parse.add(initial, blank or again, cut)
        if now is not it:
            yield done()

    yield from batches(rows(), _PARSED)


def _hash(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation its audit and then its texts -> conv_id, repaired_sha256 and what the parse found."""
    schema = _PARSED.append(pa.field("repaired_sha256", pa.string()))

    def rows() -> Iterator[tuple]:
        head, made = None, None
        for b in it:
            for is_text, role, text, parsed in zip(*(b.column(n).to_pylist() for n in ("is_text", "role", "text", "parsed")), strict=True):
                if is_text:
                    made.add(role, text)
                    continue
                if head is not None:
                    yield (*head.values(), made.digest())
                head, made = parsed, Repaired(parsed["audit"])
        if head is not None:
            yield (*head.values(), made.digest())

    yield from batches(rows(), schema)


def repair(convs: DataFrame) -> DataFrame:
    """Damages the conversations, parses them and repairs them: one row a conversation with its faults, the cost and the
    audit of the cheapest edits (K, R, D, I in order; ties by ASCII) and the digest of the repaired text."""
    rows = damage(convs)
    parsed = light(rows).mapInArrow(_parse, _PARSED_SQL)
    heads = parsed.select("conv_id", F.lit(False).alias("is_text"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("dg"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.struct(*parsed.columns).alias("parsed"))
    texts = rows.where(~F.col("dropped")).select("conv_id", F.lit(True).alias("is_text"), "turn", _digest().alias("dg"), "role", "text", F.lit(None).cast(f"struct<{_PARSED_SQL.replace(' ', ':').replace(',:', ',')}>").alias("parsed"))
    both = heads.union(texts).repartition("conv_id").sortWithinPartitions("conv_id", "is_text", F.col("turn").asc_nulls_first(), "dg")
    return both.mapInArrow(_hash, _PARSED_SQL + ", repaired_sha256 string")


#: DuckDB has no crc32: its bits by hand. The text is ASCII.
CRC32 = "xor(list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT for x in string_split({}, '')], lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"

#: The grammar again, as tables: symbol, symbol by k inserted turns, lines of these, edit and symbol after it.
ORACLE = rf"""
WITH RECURSIVE d0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations),
d1 AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d0 WHERE f <> 0),
d2 AS (SELECT *, md5(length(role)::VARCHAR || ':' || role || text) AS dg, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last FROM d1),
d3 AS (SELECT conv_id, turn, role, text, left(role, 1) AS ini, last = '' AS blank, last NOT IN ('.', '!', '?') AS cut,
    row_number() OVER (PARTITION BY conv_id, dg ORDER BY turn NULLS FIRST) > 1 AS again, dg FROM d2),
d4 AS (SELECT *, n > 1 AND lag(ini) OVER (PARTITION BY conv_id ORDER BY n) || ini NOT IN ('su', 'ua', 'au') AS bad
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg, again) AS n FROM d3)),
figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (bad) AS illegal, max(n) AS top FROM d4 GROUP BY conv_id),
inserts(s, k, m, lines) AS (VALUES ('O',0,'O',''), ('O',1,'H','user:' || chr(10)), ('O',2,'F','user:' || chr(10) || 'assistant:' || chr(10)), ('S',0,'S',''), ('S',1,'H','user:' || chr(10)), ('S',2,'F','user:' || chr(10) || 'assistant:' || chr(10)),
    ('H',0,'H',''), ('H',1,'F','assistant:' || chr(10)), ('F',0,'F',''), ('F',1,'H','user:' || chr(10))),
moves(m, t, z) AS (VALUES ('O','s','S'), ('O','u','H'), ('S','u','H'), ('F','u','H'), ('H','a','F')),
edits AS (SELECT m, 'D' AS e, '' AS t, m AS z FROM (SELECT DISTINCT m FROM inserts) UNION ALL SELECT m, 'K', t, z FROM moves UNION ALL SELECT m, 'R', t, z FROM moves WHERE t <> 's'),
chart(conv_id, n, s, cost, audit, made) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 'O', 0::BIGINT, '', '' FROM d0
  UNION ALL
  SELECT conv_id, n, z, cost, audit, made FROM (
    SELECT c.conv_id, r.n, e.z, c.cost + 3 * i.k + CASE e.e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.e <> 'D' AND r.cut THEN 3 ELSE 0 END AS cost, c.audit || repeat('I', i.k) || e.e AS audit,
      c.made || i.lines || CASE e.e WHEN 'D' THEN '' WHEN 'K' THEN r.role || ':' || r.text || chr(10) ELSE CASE e.t WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text || chr(10) END AS made
    FROM chart c JOIN d4 r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.n = c.n + 1 JOIN inserts i ON i.s = c.s JOIN edits e ON e.m = i.m
    WHERE (e.e = 'D' OR NOT (r.blank OR r.again)) AND (e.e <> 'K' OR e.t = r.ini))
  QUALIFY row_number() OVER (PARTITION BY conv_id, z ORDER BY cost, audit) = 1),
ended AS (SELECT c.conv_id, c.n, c.cost + 3 * i.k AS cost, c.audit || repeat('I', i.k) AS audit, c.made || i.lines AS made
  FROM chart c JOIN inserts i ON i.s = c.s LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id WHERE c.n = coalesce(f.top, 0) AND i.m IN ('O', 'F')
  QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY c.cost + 3 * i.k, c.audit || repeat('I', i.k)) = 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  e.cost, e.audit, sha256(left(made, greatest(length(made) - 1, 0))) AS repaired_sha256
FROM ended e LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM e.conv_id"""
