"""Text formats written from tables: GFA, BED, GAF, and the manifest of a build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sign(ori) -> F.Column:
    return F.when(ori == 1, "+").otherwise("-")


def segment_lines(seg: DataFrame) -> DataFrame:
    """S lines of (seg_id, seq); a missing sequence is `*`."""
    return seg.select(F.concat_ws("\t", F.lit("S"), "seg_id", F.coalesce("seq", F.lit("*"))).alias("line"))


def link_lines(links: DataFrame) -> DataFrame:
    """L lines of (a, a_ori, b, b_ori) without overlap."""
    return links.select(F.concat_ws("\t", F.lit("L"), "a", sign(F.col("a_ori")), "b", sign(F.col("b_ori")), F.lit("0M")).alias("line"))


def path_text(steps: DataFrame, *by: str) -> DataFrame:
    """(by, path, total): each walk as `>1<2`, in the order of pos, with its length."""
    token = F.concat(F.when(F.col("ori") == 1, ">").otherwise("<"), F.col("seg_id").cast("string"))
    d = steps.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", token.alias("t")))).alias("x"), F.sum("bp").alias("total"))
    return d.select(*by, F.array_join(F.transform("x", lambda s: s["t"]), "").alias("path"), "total")


def walk_lines(steps: DataFrame, names: DataFrame) -> DataFrame:
    """W lines of steps(contig, pos, seg_id, ori, bp) and names(contig, sample, hap)."""
    d = path_text(steps, "contig").join(names, "contig")
    return d.select(F.concat_ws("\t", F.lit("W"), "sample", "hap", "contig", F.lit(0), "total", "path").alias("line"))


def write_lines(lines: DataFrame, path: str, order: tuple[str, ...] = ()) -> str:
    """The column line as text files; with order, the files in turn hold the lines in this order."""
    d = lines.orderBy(*order) if order else lines
    d.select("line").write.text(path)
    return path


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows, columns, digest): the rows and a digest of each table that does not depend on their order."""
    out = None
    for name, df in sorted(tables.items()):
        text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
        part = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(20,0)")
        one = df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))
        one = one.select(F.lit(name).alias("name"), "n_rows", F.lit(",".join(sorted(df.columns))).alias("columns"), "digest")
        out = one if out is None else out.unionByName(one)
    return out
