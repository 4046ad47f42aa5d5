"""Difference strings (cs) and CIGARs as columns: each string is parsed once, in one pass, over Arrow batches.

A difference string is a run of operations: `:n` n equal bases, `*xy` reference x read y, `+seq` inserted, `-seq` deleted.
An operation is a struct (kind, len, ref, alt, at): kind one of `:*+-`, len its length in bases, ref and alt its text,
at its offset on the reference. A parse is linear in the string; what is built from it stays in expressions. All functions
take and return columns; a null string gives null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bases and their complements, either case.
BASES, COMPLEMENTS = "ACGTNacgtn", "TGCANtgcan"
_CS = re.compile(r":([0-9]+)|[*]([a-zA-Z])([a-zA-Z])|[+]([a-zA-Z]+)|-([a-zA-Z]+)")
_CIGAR = re.compile(r"([0-9]+)([MIDNSHP=X])")
#: CIGAR operation of each kind, and the operations that use up reference bases.
KINDS = {":": "=", "*": "X", "+": "I", "-": "D"}
ON_REFERENCE = frozenset("MDN=X")

_OP = pa.struct([("kind", pa.string()), ("len", pa.int32()), ("ref", pa.string()), ("alt", pa.string()), ("at", pa.int32())])
_SPAN = pa.struct([("op", pa.string()), ("len", pa.int32()), ("at", pa.int32())])


def _listed(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields.items()]))


def reverse_complement(seq: Column) -> Column:
    """Complement of A, C, G, T and N in either case, read backwards; other letters stay."""
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def parse_cs(cs: str) -> Iterator[tuple[str, int, str, str, int]]:
    """(kind, len, ref, alt, at) of the operations that are not empty."""
    at = 0
    for same, ref, alt, put, cut in _CS.findall(cs):
        if same:
            n = int(same)
            if n:
                yield ":", n, "", "", at
        elif ref:
            n = 1
            yield "*", 1, ref, alt, at
        elif put:
            yield "+", len(put), "", put, at
            n = 0
        else:
            n = len(cut)
            yield "-", n, cut, "", at
        at += n


def parse_cigar(cigar: str) -> Iterator[tuple[str, int, int]]:
    """(op, len, at) of the operations of a CIGAR."""
    at = 0
    for n, op in _CIGAR.findall(cigar):
        yield op, int(n), at
        at += int(n) if op in ON_REFERENCE else 0


def _merged(cs: str) -> str | None:
    """CIGAR of a difference string."""
    runs = groupby(parse_cs(cs), key=lambda o: o[0])
    return "".join(f"{sum(o[1] for o in run)}{KINDS[k]}" for k, run in runs) or None


def _lists(column: pa.Array, parse, kind: pa.StructType) -> pa.Array:
    """The parses of a column of strings as lists of structs."""
    offsets, flat, valid = [0], [], []
    for s in column.to_pylist():
        valid.append(s is not None)
        if s is not None:
            flat.extend(parse(s))
        offsets.append(len(flat))
    fields = zip(*flat, strict=True) if flat else [()] * kind.num_fields
    items = pa.StructArray.from_arrays([pa.array(list(v), f.type) for v, f in zip(fields, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, mask=pa.array([not v for v in valid]))


@F.arrow_udf(_listed(kind=T.StringType(), len=T.IntegerType(), ref=T.StringType(), alt=T.StringType(), at=T.IntegerType()))
def _ops(cs: pa.Array) -> pa.Array:
    return _lists(cs, parse_cs, _OP)


@F.arrow_udf(_listed(op=T.StringType(), len=T.IntegerType(), at=T.IntegerType()))
def _spans(cigar: pa.Array) -> pa.Array:
    return _lists(cigar, parse_cigar, _SPAN)


@F.arrow_udf(T.StringType())
def _cigar(cs: pa.Array) -> pa.Array:
    return pa.array([None if s is None else _merged(s) for s in cs.to_pylist()], pa.string())


def cs_ops(cs: Column) -> Column:
    """The operations of a difference string with their offsets on the reference."""
    return _ops(cs)


def cs_to_cigar(cs: Column) -> Column:
    """CIGAR of a difference string: = X I D, neighbours of one kind merged; null if there is no operation."""
    return _cigar(cs)


def cs_has_difference(cs: Column) -> Column:
    return cs.rlike("[*+-]")


def cs_slice(cs: Column, lo: Column, hi: Column, reverse: Column | None = None) -> Column:
    """The difference string of reference offsets [lo, hi): equal and deleted bases are clipped, substitutions and
    insertions stay if their offset lies inside; on the reverse strand the order turns and bases are complemented."""
    clip = lambda o: F.greatest(F.least(o["at"] + o["len"], hi) - F.greatest(o["at"], lo), F.lit(0))
    kept = F.filter(
        F.transform(
            cs_ops(cs),
            lambda o: F.struct(
                o["kind"].alias("kind"),
                F.when(o["kind"].isin(":", "-"), clip(o)).when((o["at"] >= lo) & (o["at"] < hi), o["len"]).otherwise(0).alias("len"),
                F.when(o["kind"] == "-", F.substr(o["ref"], F.greatest(lo - o["at"], F.lit(0)) + 1, clip(o))).otherwise(o["ref"]).alias("ref"),
                o["alt"].alias("alt"),
            ),
        ),
        lambda o: o["len"] > 0,
    )

    def text(ops: Column, turn) -> Column:
        one = lambda o: F.when(o["kind"] == ":", F.concat(F.lit(":"), o["len"].cast("string"))).otherwise(F.concat(o["kind"], turn(o["ref"]), turn(o["alt"])))
        return F.array_join(F.transform(ops, one), "")

    forward = text(kept, lambda x: x)
    if reverse is None:
        return forward
    return F.when(reverse, text(F.reverse(kept), reverse_complement)).otherwise(forward)


def cs_substitutions(cs: Column) -> Column:
    """Array of (at, ref, alt) of the substitutions."""
    return F.transform(F.filter(cs_ops(cs), lambda o: o["kind"] == "*"), lambda o: F.struct(o["at"].alias("at"), o["ref"].alias("ref"), o["alt"].alias("alt")))


def cs_insertions(cs: Column) -> Column:
    """Array of (at, seq) of the insertions."""
    return F.transform(F.filter(cs_ops(cs), lambda o: o["kind"] == "+"), lambda o: F.struct(o["at"].alias("at"), o["alt"].alias("seq")))


def cigar_spans(cigar: Column) -> Column:
    """Array of (op, len, at): the operations of a CIGAR with their offsets on the reference."""
    return _spans(cigar)


def cigar_slice(cigar: Column, lo: Column, hi: Column, reverse: Column | None = None) -> Column:
    """The CIGAR of reference offsets [lo, hi); insertions stay if their offset lies inside; on the reverse strand the
    order of operations turns."""
    kept = F.filter(
        F.transform(
            cigar_spans(cigar),
            lambda o: F.struct(
                o["op"].alias("op"),
                F.when(o["op"].isin("M", "D", "N", "=", "X"), F.greatest(F.least(o["at"] + o["len"], hi) - F.greatest(o["at"], lo), F.lit(0)))
                .when((o["at"] >= lo) & (o["at"] < hi), o["len"])
                .otherwise(0)
                .alias("len"),
            ),
        ),
        lambda o: o["len"] > 0,
    )
    join = lambda ops: F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")
    return join(kept) if reverse is None else F.when(reverse, join(F.reverse(kept))).otherwise(join(kept))


def cigar_totals(cigar: Column) -> Column:
    """Struct (match, mismatch, inserted, deleted) of bases; M counts as a match."""
    zero = F.struct(*[F.lit(0).alias(n) for n in ("match", "mismatch", "inserted", "deleted")])

    def put(acc: Column, o: Column) -> Column:
        add = lambda name, *kinds: (acc[name] + F.when(o["op"].isin(*kinds), o["len"]).otherwise(0)).alias(name)
        return F.struct(add("match", "=", "M"), add("mismatch", "X"), add("inserted", "I"), add("deleted", "D"))

    return F.aggregate(cigar_spans(cigar), zero, put)
