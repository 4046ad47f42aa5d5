"""Read alignments in GAF text: plain or gzip, `@` headers skipped, lines of fewer than twelve fields left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions.names import path_tokens


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """(read_name, query_len, query_start, query_end, path, path_len, path_start, path_end, mapq, tags)."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("@"))).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 12)
    number = lambda i: F.get("f", F.lit(i)).try_cast("long")
    return lines.select(
        F.get("f", F.lit(0)).alias("read_name"), number(1).alias("query_len"), number(2).alias("query_start"), number(3).alias("query_end"),
        F.get("f", F.lit(5)).alias("path"), number(6).alias("path_len"), number(7).alias("path_start"), number(8).alias("path_end"),
        number(11).alias("mapq"), F.slice("f", F.lit(13), F.greatest(F.size("f") - 12, F.lit(0))).alias("tags"),
    )


def tag(name: str):
    """The value of a tag such as cs or cg, null if it is not there."""
    return F.get(F.transform(F.filter("tags", lambda t: F.startswith(t, F.lit(f"{name}:"))), lambda t: F.substr(t, F.lit(len(name) + 4))), F.lit(0))


def without_tags(*dropped: str):
    """All tags but those of the given names; unknown tags stay."""
    return F.filter("tags", lambda t: ~F.split_part(t, F.lit(":"), F.lit(1)).isin(*dropped))


def read_steps(aln: DataFrame, segments: DataFrame) -> DataFrame:
    """(read_name, pos, seg_id, ori, bp, known, off, a0, a1) of alignments whose coordinates are numbers.

    A segment that the graph does not have is no step of the offsets: it adds nothing, known is 0. [a0, a1) is what the
    alignment covers of the segment, on the path."""
    from pyspark.sql import Window

    d = aln.where("path_start is not null and path_end is not null").select("read_name", "path_start", "path_end", F.posexplode(path_tokens(F.col("path"))).alias("i", "t"))
    d = d.select("read_name", "path_start", "path_end", (F.col("i") + 1).cast("long").alias("pos"), "t.seg_id", "t.ori").join(segments.select("seg_id", "bp"), "seg_id", "left")
    d = d.withColumn("known", F.col("bp").isNotNull().cast("long")).withColumn("bp", F.coalesce("bp", F.lit(0)))
    along = Window.partitionBy("read_name").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("off", F.sum("bp").over(along) - F.col("bp"))
    return d.select("read_name", "pos", "seg_id", "ori", "bp", "known", "off", F.greatest("path_start", "off").alias("a0"), F.least("path_end", F.col("off") + F.col("bp")).alias("a1"))
