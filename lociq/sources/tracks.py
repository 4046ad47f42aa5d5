"""Annotation tracks in text: cytogenetic bands, GTF genes and exons, BED regions; all as half-open intervals from 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """The fields of the lines at a path, or of lines(line) themselves."""
    lines = spark.read.text(source) if isinstance(source, str) else source.select(F.explode(F.array("line")).alias("value"))  # a line is made once, not once for each use
    return lines.where((F.trim("value") != "") & ~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("f"))


def bands(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, stop, name, stain)."""
    at = lambda i: F.get("f", F.lit(i))
    return _fields(spark, path).where(F.size("f") >= 5).select(at(0).alias("contig"), at(1).cast("long").alias("start"), at(2).cast("long").alias("stop"), at(3).alias("name"), at(4).alias("stain"))


def gtf(spark: SparkSession, path: str | DataFrame, feature: str, gene_types: Sequence[str] | None = None) -> DataFrame:
    """(contig, start, stop, reverse, gene_id, gene_name, gene_type) of one feature, of the given gene types if any."""
    at = lambda i: F.get("f", F.lit(i))
    said = lambda name: F.nullif(F.regexp_extract(at(8), f'{name} "([^"]*)"', 1), F.lit(""))
    d = _fields(spark, path).where((F.size("f") >= 9) & (at(2) == feature)).select(
        at(0).alias("contig"), (at(3).cast("long") - 1).alias("start"), at(4).cast("long").alias("stop"), (at(6) == "-").cast("long").alias("reverse"),
        said("gene_id").alias("gene_id"), said("gene_name").alias("gene_name"), said("gene_type").alias("gene_type"),
    )
    return d if gene_types is None else d.where(F.col("gene_type").isin(*gene_types))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, stop, class); the class is `region` where there is none."""
    at = lambda i: F.get("f", F.lit(i))
    return _fields(spark, path).where(F.size("f") >= 3).select(at(0).alias("contig"), at(1).cast("long").alias("start"), at(2).cast("long").alias("stop"), F.coalesce(at(3), F.lit("region")).alias("class"))


def aliases(names: DataFrame, alias, name: str = "contig") -> DataFrame:
    """(alias, name) of the aliases that mean one name only."""
    d = names.select(F.col(name).alias("name"), alias.alias("alias")).distinct()
    return d.groupBy("alias").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n = 1").select("alias", "name")
