"""Names of walks, groups and nodes as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_range(name: Column) -> Column:
    """A name without the range that may close it, as in `chr1[10-20]`."""
    return F.regexp_replace(name, r"\[[^\]]*\]$", "")


def parse_group(name: Column) -> Column:
    """Struct (sample, haplotype, contig) of a walk name.

    What stands before the first `[` counts. With no `#` or `.` all three are the name; with one, sample and haplotype are
    what stands before it; with more, they are what stands before the first and before the second. The contig is always
    the whole name."""
    base = F.split_part(name, F.lit("["), F.lit(1))
    first = F.regexp_extract(base, r"^([^#.]*)[#.]", 1)
    second = F.regexp_extract(base, r"^([^#.]*[#.][^#.]*)[#.]", 1)
    n = F.length(base) - F.length(F.translate(base, "#.", ""))
    return F.struct(
        F.when(n == 0, base).otherwise(first).alias("sample"),
        F.when(n == 0, base).when(n == 1, first).otherwise(second).alias("haplotype"),
        base.alias("contig"),
    )


def haplotype_key(name: Column) -> Column:
    """`sample#haplotype` if there are three fields and the second is a number, else the sample."""
    f = F.split(name, "#")
    numbered = (F.size(f) >= 3) & F.get(f, F.lit(1)).rlike("^[0-9]+$")
    return F.when(numbered, F.concat_ws("#", F.get(f, F.lit(0)), F.get(f, F.lit(1)))).otherwise(F.get(f, F.lit(0)))


def contig_of(name: Column) -> Column:
    """The last field between `#` or `.`."""
    return F.element_at(F.split(name, "[#.]"), -1)


def sample_of(name: Column) -> Column:
    """The first field; `#` separates before `.` does."""
    return F.when(F.contains(name, F.lit("#")), F.split_part(name, F.lit("#"), F.lit(1))).otherwise(F.split_part(name, F.lit("."), F.lit(1)))


def node_name(kind: Column, number: Column) -> Column:
    """Display name of a tree node: root, n for leaves (kind 0), G for groups (1), S for bubbles (2), X otherwise."""
    return F.when(number.isNull(), F.lit("root")).otherwise(F.concat(F.when(kind == 0, "n").when(kind == 1, "G").when(kind == 2, "S").otherwise("X"), number.cast("string")))


def path_tokens(path: Column) -> Column:
    """Array of (seg_id, ori) of a path written `>1<2` (W lines, alignments) or `1+,2-` (P lines)."""
    arrow = F.transform(F.regexp_extract_all(path, F.lit(r"([<>][0-9]+)"), F.lit(1)), lambda t: F.struct(F.substr(t, F.lit(2)).cast("long").alias("seg_id"), F.when(F.substring(t, 1, 1) == ">", 1).otherwise(0).cast("long").alias("ori")))
    signed = F.transform(F.regexp_extract_all(path, F.lit(r"([0-9]+[+-])"), F.lit(1)), lambda t: F.struct(F.substr(t, F.lit(1), F.length(t) - 1).cast("long").alias("seg_id"), F.when(F.right(t, F.lit(1)) == "+", 1).otherwise(0).cast("long").alias("ori")))
    return F.when(path.rlike("^[<>]"), arrow).otherwise(signed)


def fasta(name: Column, seq: Column, width: int = 60) -> Column:
    """A FASTA record, the sequence wrapped."""
    return F.concat(F.lit(">"), name, F.lit("\n"), F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n")))


def clustal_blocks(name: Column, seq: Column, width: int = 60) -> Column:
    """Array of (block, line) of an aligned row in the CLUSTAL layout: names padded to 16."""
    n = F.ceil(F.length(seq) / F.lit(width)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(i.alias("block"), F.concat(F.rpad(name, 16, " "), F.substr(seq, i * width + 1, F.lit(width))).alias("line")))
