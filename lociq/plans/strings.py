"""Names, difference strings, CIGARs and scales over the projected tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions import alignment as C
from lociq.functions import names as N
from lociq.functions import scales as S
from lociq.operators.graph import r6
from lociq.plans.catalogue import _nodes, _rep, _visits_by_hap, query
from lociq.sources import projection as P


#: What a step's string holds between its two runs of equal bases, and what it ends with.
_MIDDLES, _ENDS = ("*ag*ct+gg-tt", "+a", "-acg", "*ga:3*tc+cgt"), ("", "*tg", "-c")


def _differences(spark: SparkSession, sf: str) -> DataFrame:
    """Steps with a difference string whose operations vary: runs of equal bases, at times empty, and other operations."""
    s = P.steps(spark, sf).withColumn("a", F.expr("pos % bp")).withColumn("b", F.expr("seg_id % 5"))
    pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i + 1).cast("int"))
    return s.withColumn("cs", F.concat(F.lit(":"), "a", pick(_MIDDLES, (F.col("seg_id") + F.col("pos")) % 4), F.lit(":"), "b", pick(_ENDS, F.col("contig") % 3)))


#: The twin's parse of the same strings: one row an operation.
_OPS = f"""txt AS (SELECT contig, pos, pos % bp AS a, ':' || (pos % bp) || {list(_MIDDLES)}[(seg_id + pos) % 4 + 1] || ':' || (seg_id % 5) || {list(_ENDS)}[contig % 3 + 1] AS cs FROM stp),
raw AS (SELECT contig, pos, a, unnest(regexp_extract_all(cs, ':[0-9]+|[*][a-z][a-z]|[+][a-z]+|-[a-z]+')) AS o, generate_subscripts(regexp_extract_all(cs, ':[0-9]+|[*][a-z][a-z]|[+][a-z]+|-[a-z]+'), 1) AS i FROM txt),
ops AS (SELECT *, left(o, 1) AS kind, CASE left(o, 1) WHEN ':' THEN substring(o, 2)::BIGINT WHEN '*' THEN 1 ELSE length(o) - 1 END AS n FROM raw),
op AS (SELECT *, coalesce(sum(CASE kind WHEN '+' THEN 0 ELSE n END) OVER (PARTITION BY contig, pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spot, translate(kind, ':*+-', '=XID') AS c FROM ops WHERE n > 0),
chg AS (SELECT *, CASE WHEN lag(c) OVER (PARTITION BY contig, pos ORDER BY i) = c THEN 0 ELSE 1 END AS new FROM op),
grp AS (SELECT *, sum(new) OVER (PARTITION BY contig, pos ORDER BY i) AS g FROM chg),
cig AS (SELECT contig, pos, string_agg(n || c, '' ORDER BY g) AS cigar FROM (SELECT contig, pos, g, c, sum(n)::BIGINT AS n FROM grp GROUP BY ALL) GROUP BY 1, 2)"""


@query(f""", {_OPS} SELECT contig, pos, cigar, count(*) FILTER (kind = '*') AS n_sub, string_agg(CASE kind WHEN '+' THEN substring(o, 2) END, ',' ORDER BY i) AS inserted,
min(spot) FILTER (kind = '*') AS first_sub, (count(*) FILTER (kind <> ':') > 0)::BIGINT AS differs FROM op JOIN cig USING (contig, pos) GROUP BY ALL""")
def cs_merged_cigar(spark, sf):
    """Neighbouring operations of one kind become one; substitutions and insertions with their places."""
    d = _differences(spark, sf)
    subs, ins = C.cs_substitutions(F.col("cs")), C.cs_insertions(F.col("cs"))
    inserted = F.nullif(F.array_join(F.transform(ins, lambda x: x["seq"]), ","), F.lit(""))
    return d.select("contig", "pos", C.cs_to_cigar(F.col("cs")).alias("cigar"), F.size(subs).cast("long").alias("n_sub"), inserted.alias("inserted"), F.get(subs, F.lit(0))["at"].cast("long").alias("first_sub"), C.cs_has_difference(F.col("cs")).cast("long").alias("differs"))


@query(f""", {_OPS} SELECT contig, pos, coalesce(sum(n) FILTER (kind = ':'), 0)::BIGINT AS matched, coalesce(sum(n) FILTER (kind = '*'), 0)::BIGINT AS mismatched,
coalesce(sum(n) FILTER (kind = '+'), 0)::BIGINT AS inserted, coalesce(sum(n) FILTER (kind = '-'), 0)::BIGINT AS deleted FROM op GROUP BY 1, 2""")
def cigar_stats(spark, sf):
    """Bases by kind of operation, from the CIGAR."""
    t = C.cigar_totals(C.cs_to_cigar(F.col("cs")))
    d = _differences(spark, sf).select("contig", "pos", t.alias("t"))
    return d.select("contig", "pos", F.col("t.match").cast("long").alias("matched"), F.col("t.mismatch").cast("long").alias("mismatched"), F.col("t.inserted").cast("long").alias("inserted"), F.col("t.deleted").cast("long").alias("deleted"))


@query(f""", {_OPS}, cut AS (SELECT *, CASE WHEN kind IN (':', '-') THEN greatest(least(spot + n, a + 3) - greatest(spot, 1), 0) WHEN spot >= 1 AND spot < a + 3 THEN n ELSE 0 END AS m FROM op),
txt2 AS (SELECT *, CASE kind WHEN ':' THEN '' WHEN '-' THEN substring(o, 2 + greatest(1 - spot, 0)::INT, m::INT) ELSE substring(o, 2) END AS s FROM cut WHERE m > 0),
sg AS (SELECT *, sum(CASE WHEN l = c THEN 0 ELSE 1 END) OVER (PARTITION BY contig, pos ORDER BY i) AS g2 FROM (SELECT *, lag(c) OVER (PARTITION BY contig, pos ORDER BY i) AS l FROM txt2)),
sc AS (SELECT contig, pos, string_agg(n2 || c, '' ORDER BY g2) AS cigar FROM (SELECT contig, pos, g2, c, sum(m)::BIGINT AS n2 FROM sg GROUP BY ALL) GROUP BY 1, 2)
SELECT t.contig, t.pos, coalesce(plus, '') AS plus, coalesce(minus, '') AS minus, coalesce(cigar, '') AS cigar FROM txt t LEFT JOIN (SELECT contig, pos, string_agg(kind || CASE kind WHEN ':' THEN m::VARCHAR ELSE s END, '' ORDER BY i) AS plus,
  string_agg(kind || CASE kind WHEN ':' THEN m::VARCHAR WHEN '*' THEN translate(s, 'acgt', 'tgca') ELSE reverse(translate(s, 'acgt', 'tgca')) END, '' ORDER BY i DESC) AS minus FROM txt2 GROUP BY 1, 2) x USING (contig, pos) LEFT JOIN sc USING (contig, pos)""")
def cs_slices(spark, sf):
    """The window from the second reference base to the third after the first run, on either strand, and the same of the CIGAR."""
    lo, hi = F.lit(1), (F.col("a") + 3).cast("int")
    d, cs = _differences(spark, sf), F.col("cs")
    return d.select("contig", "pos", C.cs_slice(cs, lo, hi, F.lit(False)).alias("plus"), C.cs_slice(cs, lo, hi, F.lit(True)).alias("minus"), C.cigar_slice(C.cs_to_cigar(cs), lo, hi).alias("cigar"))


@query("""SELECT contig, s.sample AS sample, s.haplotype AS haplotype, s.contig AS base, key, tail, head FROM (SELECT contig, CASE contig % 4
WHEN 0 THEN struct_pack(sample := sample, haplotype := sample || '#' || hap, contig := sample || '#' || hap || '#' || contig)
WHEN 1 THEN struct_pack(sample := sample, haplotype := sample, contig := sample || '.' || contig)
WHEN 2 THEN struct_pack(sample := 'w' || contig, haplotype := 'w' || contig, contig := 'w' || contig)
ELSE struct_pack(sample := sample, haplotype := sample || '.h' || hap, contig := sample || '.h' || hap || '#c') END AS s,
CASE contig % 4 WHEN 0 THEN sample || '#' || hap WHEN 1 THEN sample || '.' || contig || '[3-9]' WHEN 2 THEN 'w' || contig ELSE sample || '.h' || hap END AS key,
CASE contig % 4 WHEN 0 THEN contig::VARCHAR WHEN 1 THEN contig || '[3-9]' WHEN 2 THEN 'w' || contig ELSE 'c' END AS tail,
CASE contig % 4 WHEN 0 THEN sample WHEN 1 THEN sample WHEN 2 THEN 'w' || contig ELSE sample || '.h' || hap END AS head FROM ctg)""")
def walk_names(spark, sf):
    """Sample, haplotype and contig of names in four styles."""
    c = F.col("contig").cast("string")
    name = F.when(F.col("contig") % 4 == 0, F.concat_ws("#", "sample", "hap", c)).when(F.col("contig") % 4 == 1, F.concat("sample", F.lit("."), c, F.lit("[3-9]")))
    name = name.when(F.col("contig") % 4 == 2, F.concat(F.lit("w"), c)).otherwise(F.concat("sample", F.lit(".h"), "hap", F.lit("#c")))
    d = P.contigs(spark, sf).select("contig", name.alias("name"))
    g, n = N.parse_group(F.col("name")), F.col("name")
    d = d.select("contig", g.alias("g"), N.haplotype_key(n).alias("key"), N.contig_of(n).alias("tail"), N.sample_of(n).alias("head"))
    return d.select("contig", "g.sample", "g.haplotype", F.col("g.contig").alias("base"), "key", "tail", "head")


@query("""SELECT seg_id, '>n' || seg_id || chr(10) || (CASE WHEN bp > 20 THEN substring(seq50, 1, 20) || chr(10) || (CASE WHEN bp > 40 THEN substring(seq50, 21, 20) || chr(10) || substring(seq50, 41, (bp - 40)::INT) ELSE substring(seq50, 21, (bp - 20)::INT) END) ELSE substring(seq50, 1, bp::INT) END) AS record,
(bp + 19) // 20 AS blocks, rpad('n' || seg_id, 16, ' ') || substring(seq50, 1, least(bp, 20)::INT) AS first_line FROM seg""")
def fasta_records(spark, sf):
    """Sequences as FASTA and as CLUSTAL blocks, both 20 bases wide."""
    seq = F.expr("substring(seq50, 1, cast(bp as int))")
    d = P.segments(spark, sf).select("seg_id", "name", seq.alias("seq"))
    blocks = N.clustal_blocks(F.col("name"), F.col("seq"), 20)
    return d.select("seg_id", N.fasta(F.col("name"), F.col("seq"), 20).alias("record"), F.size(blocks).cast("long").alias("blocks"), F.get(blocks, F.lit(0))["line"].alias("first_line"))


@query("""SELECT o_orderkey AS id, CASE WHEN x >= 1000000 THEN regexp_replace(regexp_replace(printf('%.3f', x / 1000000.0::DOUBLE), '0+$', ''), '\\.$', '') || ' Mb' WHEN x >= 1000 THEN regexp_replace(regexp_replace(printf('%.3f', x / 1000.0::DOUBLE), '0+$', ''), '\\.$', '') || ' kb' ELSE x || ' bp' END AS label,
x AS parsed FROM (SELECT o_orderkey, (o_orderkey % 7) * (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1500 ELSE 2500000 END)::BIGINT AS x FROM orders)""")
def ruler_labels(spark, sf):
    """Positions written for a ruler and read back."""
    from lociq.session import table

    k = F.col("o_orderkey")
    x = (k % 7) * F.when(k % 3 == 0, 1).when(k % 3 == 1, 1500).otherwise(2500000).cast("long")
    d = table(spark, sf, "orders").select(k.alias("id"), x.alias("x")).withColumn("label", S.ruler(F.col("x")))
    return d.select("id", "label", S.parse_bp_column(F.col("label")).alias("parsed"))


@query("""SELECT layer, node, CASE WHEN m <= 1 THEN 1.0 WHEN m <= 2 THEN 2.0 WHEN m <= 5 THEN 5.0 ELSE 10.0 END::DOUBLE * p AS step, floor(least(ln(1 + leaves) / ln(1 + 2000), 1.0) * 1000000 + 0.5) / 1000000 AS ramp
FROM (SELECT *, (bp / 7.0::DOUBLE) / p AS m FROM (SELECT layer, node, leaves, bp, pow(10.0::DOUBLE, floor(log10(bp / 7.0::DOUBLE))) AS p FROM geo))""")
def tick_steps(spark, sf):
    """A nice tick step of the extent of every node and the shade of its density."""
    d = _nodes(spark, sf)
    return d.select("layer", "node", S.nice_step(F.col("bp").cast("double"), 7).alias("step"), r6(S.density_ramp(F.col("leaves"), F.lit(2000))).alias("ramp"))


def _curve(order: int) -> str:
    """The curve in SQL, one common table expression a level."""
    out, side = "c0 AS (SELECT seg_id, floor(x * 256)::BIGINT AS gx, floor(y * 256)::BIGINT AS gy, floor(x * 256)::BIGINT AS u, floor(y * 256)::BIGINT AS v, 0::BIGINT AS h FROM seg)", 1 << (order - 1)
    for k in range(order):
        turn = lambda own, other: f"CASE WHEN up = 1 THEN {own} % {side} WHEN rt = 1 THEN {side} - 1 - {other} % {side} ELSE {other} % {side} END"  # noqa: B023, E731
        out += f""",
c{k + 1} AS (SELECT seg_id, gx, gy, {turn("u", "v")} AS u, {turn("v", "u")} AS v, h + {side * side} * (CASE WHEN rt = 1 AND up = 1 THEN 2 WHEN rt = 1 THEN 3 WHEN up = 1 THEN 1 ELSE 0 END) AS h
FROM (SELECT *, u // {side} % 2 AS rt, v // {side} % 2 AS up FROM c{k}))"""
        side >>= 1
    return out


@query(f", {_curve(8)} SELECT seg_id, gx, gy, h::BIGINT AS h FROM c8")
def hilbert_cells(spark, sf):
    """Places of the leaves along a Hilbert curve, by which neighbours can be stored together."""
    d = P.segments(spark, sf).select("seg_id", F.floor(F.col("x") * 256).alias("gx"), F.floor(F.col("y") * 256).alias("gy"))
    return d.withColumn("h", S.hilbert(F.col("gx"), F.col("gy"), 8))


@query("""SELECT layer, node, leaves::BIGINT AS leaves, 'GBrand' AS brand_tag, NULL::VARCHAR AS absent FROM geo WHERE layer = 1""")
def json_attributes(spark, sf):
    """Attributes written as JSON and read back by path; a path that is not there is null."""
    d = _nodes(spark, sf).where("layer = 1").select("layer", "node", F.to_json(F.struct("leaves", F.substring("node", 1, 6).alias("brand"))).alias("attrs"))
    return d.select("layer", "node", F.get_json_object("attrs", "$.leaves").cast("long").alias("leaves"), F.get_json_object("attrs", "$.brand").alias("brand_tag"), F.get_json_object("attrs", "$.nothing").alias("absent"))


@query("""SELECT node, string_agg(hap::VARCHAR, ',' ORDER BY hap) AS shared, count(*) AS n FROM (SELECT DISTINCT node, hap FROM stp JOIN ctg USING (contig) JOIN rep ON rep.seg_id = stp.seg_id AND layer = 3 WHERE hap % 10 < 3) GROUP BY 1""")
def shared_haplotypes(spark, sf):
    """The haplotypes of each leaf that a list of asked ones shares with it."""
    v = _visits_by_hap(spark, sf).where("hap % 10 < 3").groupBy("seg_id").agg(F.sort_array(F.collect_set("hap")).alias("h"))
    asked = P.contigs(spark, sf).where("hap % 10 < 3").select("hap").distinct()
    d = v.withColumn("x", F.explode("h")).join(asked, F.col("x") == asked["hap"], "left_semi").groupBy("seg_id").agg(F.sort_array(F.collect_list("x")).alias("h"))
    return d.select(F.concat(F.lit("n"), "seg_id").alias("node"), F.array_join("h", ",").alias("shared"), F.size("h").cast("long").alias("n"))


@query("""SELECT layer, (CASE layer WHEN 3 THEN 'n' WHEN 2 THEN 'S' WHEN 1 THEN 'G' ELSE 'root' END) AS letter, count(*) AS n FROM geo GROUP BY 1, 2""")
def display_names(spark, sf):
    """Letters of the display names by kind."""
    kind = F.when(F.col("layer") == 3, 0).when(F.col("layer") == 2, 2).otherwise(1)
    name = N.node_name(kind, F.when(F.col("layer") > 0, F.lit(7)))
    d = _rep(spark, sf).select("layer", "node").distinct().withColumn("letter", F.regexp_replace(name, "[0-9]+$", ""))
    return d.groupBy("layer", "letter").agg(F.count("*").alias("n"))
