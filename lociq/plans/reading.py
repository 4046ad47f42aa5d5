"""Read alignments: records of a node, depth, searches, related nodes, rows and variant profiles, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociq.operators.graph import r6
from lociq.plans.catalogue import query
from lociq.sources import projection as P
from lociq.store import stored

_PARTS = """rpt AS (SELECT aln, pos, seg_id, bp, off, total, ps, pe, (CASE WHEN pos % 3 = 0 THEN 0 ELSE 1 END)::BIGINT AS ori, greatest(ps, off) AS a0, least(pe, off + bp) AS a1, aln % 60 AS mapq FROM
(SELECT *, CASE WHEN total > 10 THEN aln % 3 ELSE 0 END AS ps, CASE WHEN total > 10 THEN total - aln % 5 ELSE total END AS pe FROM
(SELECT *, (sum(bp) OVER (PARTITION BY aln ORDER BY pos) - bp)::BIGINT AS off, (sum(bp) OVER (PARTITION BY aln))::BIGINT AS total FROM rds))),
frs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aln, seg_id ORDER BY pos) AS v FROM rpt) WHERE v = 1)"""


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """(aln, pos, seg_id, bp, off, total, ps, pe, ori, a0, a1, mapq, first): steps of the alignments with what they cover,
    sorted by segment: the inverted lists. first: the alignment has not been on this segment before. What follows from the
    other columns is not stored."""

    def make() -> DataFrame:
        d = P.placed_reads(spark, sf).repartitionByRange("seg_id", "aln")
        return d.withColumn("first", F.row_number().over(Window.partitionBy("seg_id", "aln").orderBy("pos")) == 1)

    d = stored(spark, sf, "read_parts", make, order=("seg_id", "aln"), dealt=True, rows=lambda: P.items(spark, sf))
    long = F.col("total") > 10
    d = d.withColumn("ps", F.when(long, F.col("aln") % 3).otherwise(0).cast("long")).withColumn("pe", F.when(long, F.col("total") - F.col("aln") % 5).otherwise(F.col("total")))
    return d.select(
        "aln", "pos", "seg_id", "bp", "off", "total", "ps", "pe", F.when(F.col("pos") % 3 == 0, 0).otherwise(1).cast("long").alias("ori"),
        F.greatest("ps", "off").alias("a0"), F.least("pe", F.col("off") + F.col("bp")).alias("a1"), (F.col("aln") % 60).alias("mapq"), "first",
    )


def first_visits(d: DataFrame) -> DataFrame:
    """The first step of each alignment on each segment; d may hold some segments or alignments only."""
    if "first" in d.columns:
        return d.where(F.col("first")).drop("first")
    return d.withColumn("_v", F.row_number().over(Window.partitionBy("aln", "seg_id").orderBy("pos"))).where("_v = 1").drop("_v")


def node_records(read_parts: DataFrame, nodes: list[int], region: tuple[int, int] | None = None, margin: int | None = None, over: int = 1500) -> DataFrame:
    """(seg_id, aln, start, stop, mapq, total): the first visit of each alignment to each node as an interval of the node
    in its own direction; total counts all of them. region keeps what overlaps it; with margin, of nodes that more than
    `over` alignments visit only those that come within margin bases of an end stay."""
    d = first_visits(read_parts.where(F.col("seg_id").isin(nodes)))
    lo, hi = F.col("a0") - F.col("off"), F.col("a1") - F.col("off")
    fwd = F.col("ori") == 1
    d = d.select("seg_id", "aln", "bp", "mapq", F.when(fwd, lo).otherwise(F.col("bp") - hi).alias("start"), F.when(fwd, hi).otherwise(F.col("bp") - lo).alias("stop"))
    d = d.join(d.groupBy("seg_id").agg(F.count("*").alias("total")), "seg_id")
    if region:
        d = d.where((F.col("start") <= region[1]) & (F.col("stop") >= region[0]))
    if margin is not None:
        d = d.where((F.col("total") <= over) | (F.col("start") <= margin) | (F.col("stop") >= F.col("bp") - margin))
    return d.select("seg_id", "aln", "start", "stop", "mapq", "total")


@query(f""", {_PARTS}, r AS (SELECT seg_id, aln, bp, mapq, CASE WHEN ori = 1 THEN a0 - off ELSE bp - (a1 - off) END AS start, CASE WHEN ori = 1 THEN a1 - off ELSE bp - (a0 - off) END AS stop,
count(*) OVER (PARTITION BY seg_id) AS total FROM frs WHERE seg_id IN (3, 17, 40))
SELECT seg_id, aln, start, stop, mapq, total FROM r WHERE start <= 30 AND stop >= 2 AND (total <= 4 OR start <= 1 OR stop >= bp - 1)""")
def read_records(spark, sf):
    """Alignments of three nodes in a region; of a node with more than four only those that reach an end."""
    return node_records(parts(spark, sf), [3, 17, 40], (2, 30), 1, 4)


@query(f", {_PARTS} SELECT seg_id, floor(sum(greatest(0, a1 - a0))::DOUBLE / any_value(bp)::DOUBLE * 1000000 + 0.5) / 1000000 AS depth, max(total) AS longest FROM rpt GROUP BY 1")
def read_depth_clipped(spark, sf):
    """Covered bases by size, first and last steps clipped to the alignment."""
    d = parts(spark, sf).groupBy("seg_id").agg(F.sum(F.greatest(F.lit(0), F.col("a1") - F.col("a0"))).alias("c"), F.first("bp").alias("bp"), F.max("total").alias("longest"))
    return d.select("seg_id", r6(F.col("c").cast("double") / F.col("bp")).alias("depth"), "longest")


@query("SELECT count(*) FILTER (seg_id % 11 = 0) AS missing, count(*) AS tokens, floor(count(*) FILTER (seg_id % 11 = 0)::DOUBLE / count(*) * 1000000 + 0.5) / 1000000 AS rate FROM rds")
def read_skip_rate(spark, sf):
    """Share of tokens whose segment a graph lacks; here the graph is without every eleventh segment."""
    known = P.segments(spark, sf).where("seg_id % 11 <> 0").select("seg_id", F.lit(1).alias("known"))
    d = P.reads(spark, sf).join(known, "seg_id", "left").agg(F.count_if(F.col("known").isNull()).alias("missing"), F.count("*").alias("tokens"))
    return d.select("missing", "tokens", r6(F.col("missing").cast("double") / F.col("tokens")).alias("rate"))


_ASKED = ("51992", "r51993", "r5199", "r9")
_HIT = """SELECT * FROM (SELECT '{0}' AS asked, aln, stage, n_segments, total, query_start FROM (SELECT *, min(stage) OVER () AS best FROM
(SELECT aln, (CASE WHEN aln::VARCHAR = '{0}' THEN 0 WHEN 'r' || aln = '{0}' THEN 1 WHEN starts_with('r' || aln, '{0}') THEN 2 END)::BIGINT AS stage, count(*) AS n_segments, any_value(total) AS total, any_value(ps) AS query_start FROM rpt GROUP BY 1, 2)
WHERE stage IS NOT NULL) WHERE stage = best ORDER BY query_start, aln LIMIT 30)"""


def alignments(spark: SparkSession, sf: str) -> DataFrame:
    """(aln, n_segments, total, query_start), stored."""
    make = lambda: parts(spark, sf).groupBy("aln").agg(F.count("*").alias("n_segments"), F.first("total").alias("total"), F.first("ps").alias("query_start"))
    return stored(spark, sf, "alignments", make, order=("aln",))


@query(f", {_PARTS} " + " UNION ALL ".join(_HIT.format(a) for a in _ASKED))
def read_search(spark, sf):
    """Alignments by number, else by name, else by the beginning of a name; at most 30 each by where they start."""
    out = None
    d = alignments(spark, sf)
    for a in _ASKED:
        stage = F.when(F.col("aln").cast("string") == a, 0).when(F.concat(F.lit("r"), "aln") == a, 1).when(F.startswith(F.concat(F.lit("r"), "aln"), F.lit(a)), 2)
        hit = d.withColumn("stage", stage.cast("long")).where("stage is not null")
        best = hit.agg(F.min("stage").alias("best"))
        one = hit.join(F.broadcast(best), hit["stage"] == best["best"]).orderBy("query_start", "aln").limit(30)  # one row
        one = one.select(F.lit(a).alias("asked"), "aln", "stage", "n_segments", "total", "query_start")
        out = one if out is None else out.unionByName(one)
    return out


def related(read_parts: DataFrame, node: int, have: list[int], limit: int = 4, seeds: int = 2000) -> DataFrame:
    """(seg_id, shared, median_offset, votes): the nodes that most of the alignments through a node share, with the median of
    their offsets from it and the strand votes. At most `seeds` alignments count: those that reach an end of the node
    (within 4 bases) first, then by mapq."""
    mine = first_visits(read_parts.where(F.col("seg_id") == node))
    reaches = ((F.col("a0") - F.col("off") <= 4) | (F.col("off") + F.col("bp") - F.col("a1") <= 4)).cast("int")
    seed = mine.select("aln", F.col("off").alias("off0"), F.col("ori").alias("ori0"), reaches.alias("reaches"), "mapq").orderBy(F.desc("reaches"), F.desc("mapq"), "aln").limit(seeds)
    others = first_visits(read_parts.where(~F.col("seg_id").isin([node, *have])).join(F.broadcast(seed), "aln"))  # at most `seeds` rows
    offset = F.when(F.col("ori0") == 1, F.col("off") - F.col("off0")).otherwise(F.col("off0") - F.col("off"))
    vote = F.when(F.col("ori") == F.col("ori0"), 1).otherwise(-1)
    d = others.groupBy("seg_id").agg(F.count("*").alias("shared"), F.percentile(offset, F.lit(0.5)).alias("median_offset"), F.sum(vote).alias("votes"))
    return d.orderBy(F.desc("shared"), "seg_id").limit(limit)


@query(f""", {_PARTS}, sd AS (SELECT aln, off AS off0, ori AS ori0 FROM frs WHERE seg_id = 17 ORDER BY (a0 - off <= 4 OR off + bp - a1 <= 4)::INT DESC, mapq DESC, aln LIMIT 2000)
SELECT seg_id, count(*) AS shared, quantile_cont(CASE WHEN ori0 = 1 THEN off - off0 ELSE off0 - off END, 0.5)::DOUBLE AS median_offset, sum(CASE WHEN ori = ori0 THEN 1 ELSE -1 END)::BIGINT AS votes
FROM frs JOIN sd USING (aln) WHERE seg_id NOT IN (17, 3, 5) GROUP BY 1 ORDER BY shared DESC, seg_id LIMIT 20""")
def expand_node(spark, sf):
    return related(parts(spark, sf), 17, [3, 5], 20)


def columns_of(items: list[tuple[int, float, float, set[int]]]) -> list[int]:
    """The column of each (node, start, stop, alignments) in order of start: a node joins the column before it if it
    overlaps that and shares less than 30 % of the alignments of the smaller of both, as alternatives do."""
    out, column, end, held = [], -1, float("-inf"), set()
    for _, start, stop, alns in items:
        shared = len(alns & held) / max(1, min(len(alns), len(held))) if held else 1.0
        if column >= 0 and start < end and shared < 0.3:
            end, held = max(end, stop), held | alns
        else:
            column, end, held = column + 1, stop, set(alns)
        out.append(column)
    return out


@query(f", {_PARTS} SELECT seg_id, aln, row_number() OVER (PARTITION BY seg_id ORDER BY a0 - off, aln) AS line FROM frs WHERE seg_id <= 40")
def read_rows(spark, sf):
    """One drawing row a read: reads of the first forty nodes by where they start."""
    d = first_visits(parts(spark, sf).where("seg_id <= 40"))
    return d.select("seg_id", "aln", F.row_number().over(Window.partitionBy("seg_id").orderBy(F.col("a0") - F.col("off"), F.col("aln"))).cast("long").alias("line"))


@query(f""", {_PARTS}, s AS (SELECT seg_id, bp, (pos % bp)::BIGINT AS i, substring('ACGT', (aln % 4 + 1)::INT, 1) AS base, ori FROM rpt),
b AS (SELECT seg_id, k AS bin, ori, base, greatest(0.0::DOUBLE, least((i + 1)::DOUBLE, (k + 1) * bp / 5.0::DOUBLE) - greatest(i::DOUBLE, k * bp / 5.0::DOUBLE)) AS w FROM s, (SELECT unnest(generate_series(0, 4)) AS k)),
t AS (SELECT seg_id, bin, ori, base, sum(round_even(w * 1000000, 0)::BIGINT)::BIGINT AS n FROM b WHERE w > 0 GROUP BY 1, 2, 3, 4)
SELECT seg_id, bin, ori, sum(n)::BIGINT AS n, min(base) FILTER (n = top) AS dominant FROM (SELECT *, max(n) OVER (PARTITION BY seg_id, bin, ori) AS top FROM t) GROUP BY 1, 2, 3""")
def variant_bins(spark, sf):
    """Substitutions of the reads in five bins of each node, spread by overlap, and the base that leads each bin and
    strand: the first in the alphabet of those with most. Counted in millionths of a base."""
    d = parts(spark, sf).select("seg_id", "bp", (F.col("pos") % F.col("bp")).alias("i"), F.substr(F.lit("ACGT"), (F.col("aln") % 4 + 1).cast("int"), F.lit(1)).alias("base"), "ori")
    return rebin(d.groupBy("seg_id", "bp", "i", "base", "ori").agg(F.count("*").alias("c")), 5)


def rebin(profile: DataFrame, bins: int) -> DataFrame:
    """(seg_id, bin, ori, n, dominant) of profile(seg_id, bp, i, base, ori, c): the base at i is spread over the bins that
    it overlaps; only those bins are made."""
    width = F.col("bp") / F.lit(float(bins))
    k = F.explode(F.sequence(F.floor(F.col("i") / width), F.least(F.floor((F.col("i") + 1) / width), F.lit(bins - 1)))).alias("bin")
    d = profile.select("*", k)
    w = F.least((F.col("i") + 1).cast("double"), (F.col("bin") + 1) * F.col("bp") / F.lit(float(bins))) - F.greatest(F.col("i").cast("double"), F.col("bin") * F.col("bp") / F.lit(float(bins)))
    d = d.withColumn("w", F.rint(w * 1000000).cast("long") * F.col("c")).where(w > 0).groupBy("seg_id", "bin", "ori", "base").agg(F.sum("w").alias("n"))
    lead = F.min(F.struct((-F.col("n")).alias("m"), "base"))
    return d.groupBy("seg_id", "bin", "ori").agg(F.sum("n").alias("n"), lead.alias("x")).select("seg_id", "bin", "ori", "n", F.col("x.base").alias("dominant"))


@query(f", {_PARTS} SELECT seg_id, coalesce(nullif(count(*) FILTER (mapq >= 30), 0), count(*)) AS coverage FROM rpt GROUP BY 1")
def mapq_coverage(spark, sf):
    """Visits of well placed reads, or of all where there are none."""
    d = parts(spark, sf).groupBy("seg_id").agg(F.count("*").alias("coverage"), F.nullif(F.count_if(F.col("mapq") >= 30), F.lit(0)).alias("coverage_q30"))
    return with_mapq(d, 30).select("seg_id", "coverage")


def with_mapq(d: DataFrame, q: int) -> DataFrame:
    """d with coverage taken from coverage_q{q} where that column exists and has a value."""
    return d.withColumn("coverage", F.coalesce(f"coverage_q{q}", "coverage")) if q > 0 and f"coverage_q{q}" in d.columns else d
