"""Every query over the projected graph, and its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociq.operators import graph as G
from lociq.sources import projection as P
from lociq.store import stored

QUERIES: dict = {}
ORACLES: dict = {}
REFERENCE = "N00"


def query(sql: str | None):
    """Registers a query under its name, with its twin over the projection's common table expressions."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH RECURSIVE {P.SQL.strip()}{_GEO}" + (", " + sql.strip().removeprefix(",").strip() if sql.strip().startswith(",") else "\n" + sql.strip())).strip()
        return f

    return put


def _r(x: str) -> str:
    return f"floor(({x}) * 1000000 + 0.5) / 1000000"


def _m(x: str) -> str:
    return f"(((2 * sum(round_even({x} * 1000000, 0)::BIGINT) + count(*)) // (2 * count(*)))::BIGINT / 1000000)"


_GEO = f""",
geo AS (SELECT layer, node, count(*) AS leaves, sum(bp)::BIGINT AS bp, {_r("avg(x)")} AS cx, {_r("avg(y)")} AS cy,
  {_r("greatest(0.5 * greatest(max(x) - min(x), max(y) - min(y)), 0.001)")} AS radius,
  {_r("CASE WHEN count(*) > 1 THEN 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) ELSE 0.0 END")} AS angle FROM rep GROUP BY 1, 2),
nxt AS (SELECT contig, seg_id AS u, lead(seg_id) OVER (PARTITION BY contig ORDER BY pos) AS v FROM stp),
adj AS (SELECT least(u, v) AS a, greatest(u, v) AS b, count(*) AS n FROM nxt WHERE u <> v GROUP BY 1, 2)"""

_BOX = "layer = {0} AND cx - radius <= 0.8 AND cx + radius >= 0.2 AND cy - radius <= 0.7 AND cy + radius >= 0.1"


def _rep(spark: SparkSession, sf: str) -> DataFrame:
    return P.leaves(spark, sf)


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Drawn nodes of all layers."""
    return _boxes(spark, sf).drop(*G.BOX)


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Drawn nodes with their boxes, one partition a layer, sorted by place: a viewport skips files by their bounds."""
    return stored(spark, sf, "nodes", lambda: G.boxed(G.geometry(_rep(spark, sf))), by=("layer",), order=("x_lo", "y_lo"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct neighbours on walks."""
    return stored(spark, sf, "pairs", lambda: G.neighbours(P.links(spark, sf)), order=("a", "b"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of all layers, one partition a layer."""
    return stored(spark, sf, "edges", lambda: G.layer_edges(_pairs(spark, sf), _rep(spark, sf)), by=("layer",), order=("source", "target"))


def _visits_by_hap(spark: SparkSession, sf: str) -> DataFrame:
    """(seg_id, hap, covered, visits): walks folded by haplotype."""

    def fold() -> DataFrame:
        s = P.passes(spark, sf).join(P.contigs(spark, sf).select("contig", "hap"), "contig")
        d = s.groupBy("key", "hap").agg(F.count("*").alias("n")).join(P.weights(spark, sf), "key")
        return d.select("seg_id", "hap", (F.col("n") * F.col("bp")).alias("covered"), (F.col("n") * F.col("each")).alias("visits"))

    return stored(spark, sf, "visits", fold, order=("seg_id", "hap"))


def _box(spark: SparkSession, sf: str, layer: int) -> DataFrame:
    return G.viewport(_boxes(spark, sf), layer, 0.2, 0.8, 0.1, 0.7)


@query(f"""SELECT g.node, g.bp, c.covered, c.hb FROM geo g JOIN (SELECT rep.node, sum(stp.bp)::BIGINT AS covered, count(DISTINCT hap) AS hb
FROM stp JOIN ctg USING (contig) JOIN rep ON rep.seg_id = stp.seg_id AND layer = 1 GROUP BY 1) c ON c.node = g.node WHERE {_BOX.format(1)}""")
def viewport_coverage(spark, sf):
    rep = _rep(spark, sf).where("layer = 1")
    box = _box(spark, sf, 1).select("node", "bp")
    below = rep.select("seg_id", "node").join(box.select("node"), "node", "left_semi")  # the box first, then its coverage
    c = _visits_by_hap(spark, sf).join(below, "seg_id").groupBy("node").agg(F.sum("covered").alias("covered"), F.count_distinct("hap").alias("hb"))
    return box.join(c, "node").select("node", "bp", "covered", "hb")


@query("SELECT contig, pos, seg_id, ori, bp, start, stop FROM stp")
def walk_steps(spark, sf):
    return P.steps(spark, sf)


@query("SELECT contig, sample, hap, row_number() OVER (ORDER BY sample, hap, contig) - 1 AS contig_id, dense_rank() OVER (ORDER BY sample, hap) - 1 AS hap_id FROM ctg")
def contig_dictionary(spark, sf):
    """Dense ids of a dictionary table: as many rows as walks have names, ranked by prefix counts of samples."""
    c = P.contigs(spark, sf)
    by = Window.partitionBy("sample").orderBy("hap", "contig")
    per = c.groupBy("sample").agg(F.count("*").alias("n"), F.count_distinct("hap").alias("h"))
    before = Window.orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)  # one row a sample
    per = per.select("sample", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("h").over(before), F.lit(0)).alias("h0"))
    d = c.withColumn("r", F.row_number().over(by)).withColumn("d", F.dense_rank().over(Window.partitionBy("sample").orderBy("hap"))).join(per, "sample")
    return d.select("contig", "sample", "hap", (F.col("n0") + F.col("r") - 1).alias("contig_id"), (F.col("h0") + F.col("d") - 1).alias("hap_id"))


@query("SELECT sample, hap, count(DISTINCT contig) AS n_contigs, sum(bp)::BIGINT AS total FROM stp JOIN ctg USING (contig) GROUP BY ROLLUP (sample, hap)")
def path_groups_rollup(spark, sf):
    per = P.steps(spark, sf).groupBy("contig").agg(F.sum("bp").alias("bp")).join(P.contigs(spark, sf), "contig")
    return per.rollup("sample", "hap").agg(F.count("contig").alias("n_contigs"), F.sum("bp").alias("total"))


@query("SELECT a, b, n FROM adj")
def adjacency_pairs(spark, sf):
    return _pairs(spark, sf)


@query("SELECT seg_id, contig, sum(bp)::BIGINT AS covered FROM stp GROUP BY 1, 2")
def segment_incidence(spark, sf):
    return G.incidence(P.steps(spark, sf))


@query(""", sz AS (SELECT layer, node, sum(bp) AS size FROM rep GROUP BY 1, 2)
SELECT rep.layer, rep.node, hap, greatest(1, least(255, round_even(255.0::DOUBLE * sum(stp.bp)::DOUBLE / any_value(size)::DOUBLE, 0)))::BIGINT AS cov
FROM stp JOIN ctg USING (contig) JOIN rep ON rep.seg_id = stp.seg_id JOIN sz ON sz.layer = rep.layer AND sz.node = rep.node WHERE rep.layer < 3 GROUP BY 1, 2, 3""")
def layer_coverage(spark, sf):
    return G.layer_coverage(_visits_by_hap(spark, sf).withColumnRenamed("covered", "bp"), _rep(spark, sf).where("layer < 3"), "hap")


@query("SELECT layer, node, count(DISTINCT hap) AS hb FROM stp JOIN ctg USING (contig) JOIN rep ON rep.seg_id = stp.seg_id GROUP BY 1, 2")
def hap_breadth_nodes(spark, sf):
    return _visits_by_hap(spark, sf).select("seg_id", "hap").join(_rep(spark, sf).select("seg_id", "layer", "node"), "seg_id").groupBy("layer", "node").agg(F.count_distinct("hap").alias("hb"))


@query("SELECT layer, node, bit_or(1::BIGINT << (hap % 63)::INT) AS hm FROM stp JOIN ctg USING (contig) JOIN rep ON rep.seg_id = stp.seg_id GROUP BY 1, 2")
def hap_mask(spark, sf):
    s = _visits_by_hap(spark, sf).groupBy("seg_id").agg(F.bit_or(F.expr("shiftleft(1L, cast(hap % 63 as int))")).alias("m"))
    return s.join(_rep(spark, sf).select("seg_id", "layer", "node"), "seg_id").groupBy("layer", "node").agg(F.bit_or("m").alias("hm"))


@query(""", v AS (SELECT seg_id, hap, least(count(*), 255) AS cn FROM stp JOIN ctg USING (contig) GROUP BY 1, 2)
SELECT layer, node, hap, max(cn)::BIGINT AS cn FROM v JOIN rep USING (seg_id) WHERE layer >= 2 GROUP BY 1, 2, 3""")
def copy_number(spark, sf):
    v = _visits_by_hap(spark, sf).select("seg_id", "hap", F.least("visits", F.lit(255)).alias("cn"))
    return v.join(_rep(spark, sf).where("layer >= 2").select("seg_id", "layer", "node"), "seg_id").groupBy("layer", "node", "hap").agg(F.max("cn").cast("long").alias("cn"))


@query(f"SELECT node, leaves, bp, cx, cy, radius, angle FROM geo WHERE {_BOX.format(3)}")
def viewport_nodes(spark, sf):
    return _box(spark, sf, 3).drop("layer")


@query(f""", vis AS (SELECT node FROM geo WHERE {_BOX.format(2)}), led AS (SELECT least(p.node, q.node) AS source, greatest(p.node, q.node) AS target, sum(n)::BIGINT AS n
FROM adj JOIN rep p ON p.seg_id = a AND p.layer = 2 JOIN rep q ON q.seg_id = b AND q.layer = 2 WHERE p.node <> q.node GROUP BY 1, 2)
SELECT source, target, n FROM led WHERE source IN (SELECT node FROM vis) OR target IN (SELECT node FROM vis)""")
def viewport_edges(spark, sf):
    vis = _box(spark, sf, 2).select("node")
    e = _edges(spark, sf).where("layer = 2").drop("layer")
    near = e.join(vis, e["source"] == vis["node"], "left_semi").unionByName(e.join(vis, e["target"] == vis["node"], "left_semi"))
    return near.dropDuplicates(["source", "target"])


@query(f"""SELECT least(greatest(floor((cx - 0.2) / (0.8::DOUBLE - 0.2::DOUBLE) * 18), 0), 17)::BIGINT AS gx, least(greatest(floor((cy - 0.1) / (0.7::DOUBLE - 0.1::DOUBLE) * 11), 0), 10)::BIGINT AS gy, count(*) AS n,
{_m("cx")} AS mx, {_m("cy")} AS my, 2 * {_m("radius")} AS mw FROM geo WHERE {_BOX.format(3)} GROUP BY 1, 2""")
def viewport_grid(spark, sf):
    return G.grid(_box(spark, sf, 3), 0.2, 0.8, 0.1, 0.7, 18, 11)


@query("SELECT layer, count(*) AS n FROM geo GROUP BY 1")
def viewport_counts(spark, sf):
    return _rep(spark, sf).select("layer", "node").distinct().groupBy("layer").agg(F.count("*").alias("n"))


@query("SELECT layer, node, leaves, bp, cx, cy, radius, angle FROM geo")
def subtree_moments(spark, sf):
    return _nodes(spark, sf)


@query("""SELECT layer, least(p_node, q_node) AS source, greatest(p_node, q_node) AS target, sum(n)::BIGINT AS n FROM
(SELECT p.layer, p.node AS p_node, q.node AS q_node, n FROM adj JOIN rep p ON p.seg_id = a JOIN rep q ON q.seg_id = b AND q.layer = p.layer) WHERE p_node <> q_node GROUP BY 1, 2, 3""")
def layer_edges(spark, sf):
    return _edges(spark, sf)


_REF = f"""rf AS (SELECT stp.* FROM stp JOIN ctg USING (contig) WHERE sample = '{REFERENCE}'),
hit AS (SELECT seg_id, min(start) AS s, max(stop) AS e, min(contig) AS c0, max(contig) AS c1, count(*) AS n, sum(ori * bp) AS fwd, sum(bp) AS tot FROM rf GROUP BY 1),
ref AS (SELECT layer, node, min(s) AS ref_bp, max(e) AS ref_bp_end, min(c0) AS ref_contig, (max(n) > 1 OR min(c0) <> max(c1))::BIGINT AS ref_multi, (2 * sum(fwd) >= sum(tot))::BIGINT AS ref_strand FROM hit JOIN rep USING (seg_id) GROUP BY 1, 2)"""


def _reference(spark, sf):
    def make() -> DataFrame:
        ref = P.contigs(spark, sf).where(F.col("sample") == REFERENCE).select("contig")
        return G.reference(P.steps(spark, sf).join(ref, "contig"), _rep(spark, sf))

    return stored(spark, sf, "reference", make, by=("layer",), order=("ref_bp",), settings={"reference": REFERENCE})


@query(f", {_REF} SELECT layer, node, ref_bp, ref_bp_end, ref_contig, ref_multi, 1 - ref_multi AS is_anchor, ref_strand FROM ref")
def ref_position(spark, sf):
    return _reference(spark, sf)


@query(f""", {_REF}, t AS (SELECT unnest([5, 40, 90, 150, 100000])::BIGINT AS target),
m AS (SELECT target, layer, node, (CASE WHEN ref_bp <= target AND ref_bp_end >= target THEN 0 ELSE 1 END)::BIGINT AS off, abs(ref_bp - target) AS d, ref_multi FROM t CROSS JOIN ref)
SELECT target, layer, node, off FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY off, CASE WHEN off = 0 THEN -layer ELSE d END, ref_multi, layer DESC, node) AS r FROM m) WHERE r = 1""")
def goto_position(spark, sf):
    """The deepest node that contains a position, else the nearest: five targets against one layered table."""
    t = spark.createDataFrame([(x,) for x in (5, 40, 90, 150, 100000)], "target long")
    m = _reference(spark, sf).join(F.broadcast(t))  # five rows
    off = F.when((F.col("ref_bp") <= F.col("target")) & (F.col("ref_bp_end") >= F.col("target")), 0).otherwise(1).cast("long")
    m = m.withColumn("off", off).withColumn("key", F.when(F.col("off") == 0, -F.col("layer")).otherwise(F.abs(F.col("ref_bp") - F.col("target"))))
    best = m.groupBy("target").agg(F.min(F.struct("off", "key", "ref_multi", (-F.col("layer")).alias("up"), "node")).alias("b"))
    return best.select("target", (-F.col("b.up")).alias("layer"), "b.node", "b.off")


@query("SELECT node, min(layer) AS layer FROM rep WHERE contains(lower(node), 'standard') OR node = 'n17' OR starts_with(node, 'n12') GROUP BY 1")
def search_names(spark, sf):
    """Names that hold one text, equal another or begin with a third, from the index."""
    from lociq.operators.names_index import containing
    from lociq.plans.views import name_index

    named, lists, sizes = name_index(spark, sf)
    n = F.col("node")
    return named.where((n == "n17") | n.startswith("n12")).unionByName(containing(named, lists, sizes, "standard")).distinct()


@query("SELECT seg_id, substring(seq50, 1, bp::INT) AS seq, reverse(translate(substring(seq50, 1, bp::INT), 'ACGT', 'TGCA')) AS revcomp FROM seg WHERE bp <= 20")
def sequence_lookup(spark, sf):
    seq = F.expr("substring(seq50, 1, cast(bp as int))")
    return P.segments(spark, sf).where("bp <= 20").select("seg_id", seq.alias("seq"), F.reverse(F.translate(seq, "ACGT", "TGCA")).alias("revcomp"))


@query("SELECT seg_id, count(*)::DOUBLE AS depth, count(DISTINCT aln) AS n_reads FROM rds GROUP BY 1")
def read_depth(spark, sf):
    return P.read_counts(spark, sf).select("seg_id", F.col("depth").cast("double").alias("depth"), "n_reads")


@query(""", nx AS (SELECT seg_id AS u, lead(seg_id) OVER (PARTITION BY aln ORDER BY pos) AS v FROM rds)
SELECT least(u, v) AS a, greatest(u, v) AS b, count(*) AS support FROM nx WHERE u <> v GROUP BY 1, 2""")
def read_support(spark, sf):
    return G.adjacency(P.reads(spark, sf).withColumnRenamed("aln", "contig")).withColumnRenamed("n", "support")


@query("SELECT seg_id, string_agg(aln::VARCHAR, ',' ORDER BY aln) AS alns FROM (SELECT DISTINCT seg_id, aln FROM rds) GROUP BY 1")
def read_postings(spark, sf):
    return P.reads(spark, sf).groupBy("seg_id").agg(F.array_join(F.sort_array(F.collect_set("aln")), ",").alias("alns"))


@query(""", nb AS (SELECT a AS u, b AS v FROM adj UNION ALL SELECT b, a FROM adj),
fl AS (SELECT 1::BIGINT AS seg_id, 0::BIGINT AS hop UNION SELECT v, hop + 1 FROM fl JOIN nb ON u = seg_id WHERE hop < 2)
SELECT seg_id, min(hop) AS hop FROM fl GROUP BY 1""")
def flood_hops(spark, sf):
    return G.flood(_pairs(spark, sf), 1, 2)


@query(f""", {_REF} SELECT ref_contig || chr(9) || ref_bp || chr(9) || greatest(ref_bp_end, ref_bp + 1) || chr(9) || node || chr(9) || (CASE WHEN ref_multi = 1 THEN 0 ELSE 1000 END) || chr(9) || (CASE WHEN ref_strand = 1 THEN '+' ELSE '-' END) AS line FROM ref WHERE layer = 3""")
def export_bed_lines(spark, sf):
    end, score, strand = F.greatest("ref_bp_end", F.col("ref_bp") + 1), F.when(F.col("ref_multi") == 1, 0).otherwise(1000), F.when(F.col("ref_strand") == 1, "+").otherwise("-")
    return _reference(spark, sf).where("layer = 3").select(F.concat_ws("\t", "ref_contig", "ref_bp", end, "node", score, strand).alias("line"))


@query(""", h AS (SELECT node, count(DISTINCT hap) AS hb FROM stp JOIN ctg USING (contig) JOIN rep ON rep.seg_id = stp.seg_id AND layer = 3 GROUP BY 1),
d AS (SELECT count(*) AS depth FROM rds GROUP BY seg_id), o AS (SELECT depth, row_number() OVER (ORDER BY depth) AS r, count(*) OVER () AS n FROM d)
SELECT (SELECT max(hb) FROM h) AS max_hb, (SELECT max(depth) FROM o WHERE r = greatest(0, floor(0.99 * n) - 1) + 1) AS p99_depth""")
def max_scales(spark, sf):
    hb = _visits_by_hap(spark, sf).groupBy("seg_id").agg(F.count("*").alias("hb")).agg(F.max("hb").alias("max_hb"))
    by = P.reads(spark, sf).groupBy("seg_id").agg(F.count("*").alias("depth")).groupBy("depth").agg(F.count("*").alias("n"))  # a histogram: few rows
    w = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = by.select("depth", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    at = F.greatest(F.lit(0), F.floor(0.99 * F.col("total")) - 1) + 1
    return hb.join(h.where(F.col("upto") >= at).agg(F.min("depth").alias("p99_depth")))


@query("""SELECT least(p.node, q.node) AS source, greatest(p.node, q.node) AS target, greatest(1, count(DISTINCT hap)) AS weight
FROM nxt JOIN ctg USING (contig) JOIN rep p ON p.seg_id = u AND p.layer = 1 JOIN rep q ON q.seg_id = v AND q.layer = 1 WHERE p.node <> q.node GROUP BY 1, 2""")
def quotient_weights(spark, sf):
    s = P.steps(spark, sf)
    nxt = s.select("contig", F.col("seg_id").alias("u"), F.lead("seg_id").over(Window.partitionBy("contig").orderBy("pos")).alias("v")).where("v is not null")
    rep = _rep(spark, sf).where("layer = 1")
    a, b = rep.select(F.col("seg_id").alias("u"), F.col("node").alias("p")), rep.select(F.col("seg_id").alias("v"), F.col("node").alias("q"))
    d = nxt.join(P.contigs(spark, sf).select("contig", "hap"), "contig").join(a, "u").join(b, "v").where("p <> q")
    return d.groupBy(F.least("p", "q").alias("source"), F.greatest("p", "q").alias("target")).agg(F.greatest(F.lit(1), F.count_distinct("hap")).cast("long").alias("weight"))
