"""Sides of bubbles, pivots, packed reads, bounded floods and related columns as queries, with DuckDB twins where SQL can say it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociq.operators import graph as G
from lociq.operators import lookup as L
from lociq.operators import packing, pivots, signed
from lociq.plans.catalogue import _pairs, query
from lociq.plans.reading import _PARTS, columns_of, first_visits, parts, related
from lociq.sources import projection as P
from lociq.store import stored

_VOTES = """vs AS (SELECT contig, pos, s.seg_id, brand, ('0x' || substring(md5(brand), 1, 7))::BIGINT AS bub, s.seg_id % 2 AS rank FROM stp s JOIN seg USING (seg_id)),
vn AS (SELECT bub, rank, lag(bub) OVER w AS pb, lag(rank) OVER w AS pr FROM vs WINDOW w AS (PARTITION BY contig ORDER BY pos)),
vt AS (SELECT least(bub, pb) AS a, greatest(bub, pb) AS b, count(*) FILTER (rank = pr) AS same_votes, count(*) FILTER (rank <> pr) AS other_votes FROM vn WHERE pb <> bub GROUP BY 1, 2)"""


def votes(spark: SparkSession, sf: str) -> DataFrame:
    """(a, b, same_votes, other_votes): how often walks go from one bubble to the next on alleles of equal and of other rank.
    Bubbles are the brands, by a number; a segment's rank is that of its id modulo two. Stored."""

    def make() -> DataFrame:
        bub = F.conv(F.substring(F.md5(F.col("brand").cast("binary")), 1, 7), 16, 10).cast("long")
        at = P.steps(spark, sf).join(P.segments(spark, sf).select("seg_id", bub.alias("bub")), "seg_id").withColumn("rank", F.col("seg_id") % 2)
        w = Window.partitionBy("contig").orderBy("pos")
        d = at.select("bub", "rank", F.lag("bub").over(w).alias("pb"), F.lag("rank").over(w).alias("pr")).where("pb <> bub")
        return d.groupBy(F.least("bub", "pb").alias("a"), F.greatest("bub", "pb").alias("b")).agg(F.count_if(F.col("rank") == F.col("pr")).alias("same_votes"), F.count_if(F.col("rank") != F.col("pr")).alias("other_votes"))

    return stored(spark, sf, "votes", make, order=("a", "b"))


@query(f", {_VOTES} SELECT * FROM vt")
def side_votes(spark, sf):
    """Tallies of equal and different alleles between bubbles that walks pass one after the other."""
    return votes(spark, sf)


def settled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Sides of bubbles, and votes with kept, stored."""

    def run() -> tuple[DataFrame, DataFrame]:
        v = votes(spark, sf).where("same_votes <> other_votes")
        return signed.settle(v.select("a", "b", (F.col("same_votes") > F.col("other_votes")).cast("long").alias("same"), F.abs(F.col("same_votes") - F.col("other_votes")).alias("strength")))

    def both() -> DataFrame:
        node, kept = run()
        none = lambda *names: [F.lit(None).cast("long").alias(n) for n in names]
        return node.select("node", "component", "side", *none("a", "b", "same", "strength", "kept")).unionByName(kept.select(*none("node", "component", "side"), "a", "b", "same", "strength", "kept"))

    d = stored(spark, sf, "settled", both, order=("node", "a", "b"))
    return d.where("node is not null").select("node", "component", "side"), d.where("node is null").select("a", "b", "same", "strength", "kept")


@query(None)
def signed_sides(spark, sf):
    """The side of every bubble by the votes, strongest first."""
    return settled(spark, sf)[0]


@query(None)
def broken_votes(spark, sf):
    """The votes that the sides do not keep."""
    return settled(spark, sf)[1].where("kept = 0").drop("kept")


@query(""", e AS (SELECT seg_id AS mid, lag(seg_id) OVER w AS entry, lead(seg_id) OVER w AS leave, contig, pos FROM stp WINDOW w AS (PARTITION BY contig ORDER BY pos)),
t AS (SELECT mid, entry, leave, count(*) AS n, min(struct_pack(c := contig, p := pos)) AS first FROM e WHERE entry IS NOT NULL AND leave IS NOT NULL GROUP BY 1, 2, 3)
SELECT mid AS seg_id, entry, leave AS exit, n FROM t QUALIFY row_number() OVER (PARTITION BY mid ORDER BY n DESC, first) = 1""")
def entry_exit(spark, sf):
    """The neighbours between which walks pass each segment most often; of equals those seen first."""
    w = Window.partitionBy("contig").orderBy("pos")
    d = P.steps(spark, sf).select(F.col("seg_id"), F.lag("seg_id").over(w).alias("entry"), F.lead("seg_id").over(w).alias("exit"), F.struct("contig", "pos").alias("at")).where("entry is not null and exit is not null")
    t = d.groupBy("seg_id", "entry", "exit").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # folded before the choice
    best = t.groupBy("seg_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "entry", "exit")).alias("b"))
    return best.select("seg_id", "b.entry", "b.exit", (-F.col("b.m")).alias("n"))


def distances(spark: SparkSession, sf: str) -> DataFrame:
    """(node, pivot, hop) of five pivots, stored."""
    return stored(spark, sf, "pivots", lambda: pivots.pivots(_pairs(spark, sf), 5), order=("pivot", "node"), settings={"k": 5})


@query(None)
def pivot_hops(spark, sf):
    """Hops of every segment from five pivots that lie far apart."""
    return distances(spark, sf)


@query(None)
def pivot_plane(spark, sf):
    """Where the segments that every pivot reaches lie in the plane of the distances."""
    p = pivots.plane(distances(spark, sf))
    return p.select("node", G.r6(F.col("x")).alias("x"), G.r6(F.col("y")).alias("y"))


def packed(spark: SparkSession, sf: str) -> DataFrame:
    """(key, id, line): reads of every node in as few rows as can be, stored."""

    def make() -> DataFrame:
        d = first_visits(parts(spark, sf))
        return packing.pack(d.select(F.col("seg_id").alias("key"), F.col("aln").alias("id"), (F.col("a0") - F.col("off")).alias("start"), (F.col("a1") - F.col("off")).alias("stop")))

    return stored(spark, sf, "packed", make, order=("key", "line"), dealt=True, rows=lambda: P.items(spark, sf))


@query(None)
def packed_reads(spark, sf):
    """The drawing row of every read at every node; a row holds reads that do not overlap."""
    return packed(spark, sf).select(F.col("key").alias("seg_id"), F.col("id").alias("aln"), "line")


@query(f""", {_PARTS}, iv AS (SELECT seg_id, a0 - off AS s, a1 - off AS e FROM frs WHERE a0 < a1), ev AS (SELECT seg_id, s AS x, 1 AS d FROM iv UNION ALL SELECT seg_id, e, -1 FROM iv)
SELECT seg_id, max(depth)::BIGINT AS lines FROM (SELECT seg_id, sum(d) OVER (PARTITION BY seg_id ORDER BY x, d ROWS UNBOUNDED PRECEDING) AS depth FROM ev) GROUP BY 1""")
def packed_lines(spark, sf):
    """Rows that each node's reads take: as many as lie over its most crowded place."""
    return packed(spark, sf).groupBy(F.col("key").alias("seg_id")).agg(F.max("line").alias("lines"))


@query(""", nb AS (SELECT a AS u, b AS v FROM adj UNION ALL SELECT b, a FROM adj),
fl AS (SELECT 1::BIGINT AS seg_id, 0::BIGINT AS hop UNION SELECT v, hop + 1 FROM fl JOIN nb ON u = seg_id WHERE hop < 3),
h AS (SELECT seg_id, min(hop) AS hop FROM fl GROUP BY 1)
SELECT seg_id, hop, ((SELECT count(*) FROM h) > 60)::BIGINT AS truncated FROM h ORDER BY hop, seg_id LIMIT 60""")
def flood_capped(spark, sf):
    """At most sixty segments within three links of the first, nearest first, and whether there were more."""
    return L.capped(G.flood(_pairs(spark, sf), 1, 3, most=60), 60, "hop", "seg_id")


def _columns(t: pa.Table) -> pa.Table:
    rows = sorted(t.to_pylist(), key=lambda r: (r["start"], r["seg_id"]))
    at = columns_of([(r["seg_id"], r["start"], r["stop"], set(r["alns"])) for r in rows])
    return pa.table({"seg_id": pa.array([r["seg_id"] for r in rows], pa.int64()), "start": pa.array([r["start"] for r in rows], pa.float64()), "stop": pa.array([r["stop"] for r in rows], pa.float64()), "col": pa.array(at, pa.int64())})


@query(f""", {_PARTS}, sd AS (SELECT aln, off AS off0, ori AS ori0 FROM frs WHERE seg_id = 17 ORDER BY (a0 - off <= 4 OR off + bp - a1 <= 4)::INT DESC, mapq DESC, aln LIMIT 2000),
rl AS (SELECT seg_id, quantile_cont(CASE WHEN ori0 = 1 THEN off - off0 ELSE off0 - off END, 0.5)::DOUBLE AS start, any_value(bp) AS bp, list(aln) AS alns, count(*) AS shared
  FROM frs JOIN sd USING (aln) WHERE seg_id NOT IN (17, 3, 5) GROUP BY 1 ORDER BY shared DESC, seg_id LIMIT 20),
it AS (SELECT *, start + bp AS stop, row_number() OVER (ORDER BY start, seg_id) AS i FROM rl),
lay AS (SELECT i, seg_id, start, stop, 0 AS col, stop AS reach, alns AS held FROM it WHERE i = 1 UNION ALL
  SELECT it.i, it.seg_id, it.start, it.stop, CASE WHEN x THEN col ELSE col + 1 END, CASE WHEN x THEN greatest(reach, it.stop) ELSE it.stop END, CASE WHEN x THEN list_distinct(list_concat(held, it.alns)) ELSE it.alns END
  FROM (SELECT *, i + 1 AS j FROM lay) l JOIN it ON it.i = l.j, LATERAL (SELECT it.start < reach AND len(list_intersect(it.alns, held))::DOUBLE / greatest(1, least(len(it.alns), len(held))) < 0.3 AS x))
SELECT seg_id, start, stop, col::BIGINT AS col FROM lay""")
def expand_columns(spark, sf):
    """The related nodes of a node in columns: those that overlap and share few reads are alternatives and share one."""
    p = parts(spark, sf)
    seed = first_visits(p.where("seg_id = 17")).select("aln")
    top = related(p, 17, [3, 5], 20)
    alns = first_visits(p.join(top.select("seg_id"), "seg_id", "left_semi").join(seed, "aln", "left_semi")).groupBy("seg_id").agg(F.collect_list("aln").alias("alns"), F.first("bp").alias("bp"))
    d = top.join(alns, "seg_id").select(F.lit(1).alias("one"), "seg_id", F.col("median_offset").alias("start"), (F.col("median_offset") + F.col("bp")).alias("stop"), "alns")
    # At most the limit's twenty rows, of at most as many alignments as count for related().
    return d.groupBy("one").applyInArrow(_columns, "seg_id long, start double, stop double, col long")
