"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

Documents of a source are put in a fixed pseudo-random order and cut into blocks of a number of documents. With weight
w = share / period, block j of a source is released at slot floor(j / w) and due at slot ceil((j + 1) / w); in every slot
the released block with the earliest deadline is served (ties to the smaller source). Each source is then less than one
block off its share at every slot. The shares are integers, so the schedule repeats after `period` slots: one period is
computed once from the shares alone, and every block finds its slot by arithmetic. A source that has run out leaves its
slots empty; nothing is dropped.

A block takes the first slot from its release on that no block before it (by deadline, then source) holds, and which
slots those hold together does not depend on their order. Blocks j of all sources with one share have the same release
and deadline, so the slots free before each deadline are found from the shares and how many sources have each; a source
then needs only how many sources of each share stand before it. That makes any number of sources a range partition,
running counts and arithmetic by row.

Ranks within a source are taken in buckets of the order and shifted by the counts of the buckets before, so a source
with a third of all rows is spread like the others.

Defined results: a null source is a source of its own, shown as null; null and empty texts count as zero characters;
rows that share an id are kept and follow each other in no fixed order; documents of a source without a share of 1 or more stay, with
null slots, releases and deadlines; shares given twice for a source add up; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.session import materialize, partitions

#: Share of the largest weight.
SHARE = 100
#: Hex digits of the order that make a bucket.
DIGITS = 2


def default_shares(docs: DataFrame, size: Column) -> DataFrame:
    """(source, share): target weights in proportion to the square root of a source's size (as a rule, characters)."""
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.greatest(F.sum(F.coalesce(size, F.lit(0))), F.lit(1)).alias("chars"))
    sizes = materialize(sizes, "sizes")
    top = sizes.agg(F.max("chars").alias("top")).first()["top"]
    return sizes.select("source", F.greatest(F.lit(1), F.floor(F.lit(SHARE) * F.sqrt(F.col("chars") / F.lit(top)) + 0.5)).cast("int").alias("share"))


def _take(free: list[list[int]], start: int, n: int) -> None:
    """Removes the first n slots from start on from the free ranges [from, to)."""
    i = bisect_right(free, [start, 1 << 62]) - 1
    if i >= 0 and free[i][1] > start > free[i][0]:
        free[i : i + 1] = [[free[i][0], start], [start, free[i][1]]]
        i += 1
    elif i < 0 or free[i][0] < start:
        i += 1
    k = i
    while n:
        step = min(n, free[k][1] - free[k][0])
        free[k][0] += step
        n -= step
        k += free[k][0] == free[k][1]
    del free[i:k]


def _ties(number: dict[int, int]) -> tuple[list[tuple], list[tuple]]:
    """(share, j, tie, at) of each block of each share, and by tie (blocks due together): the shares by release, the
    free slots from each release to the next, and the free ranges as (free slots before, slot). number: sources by share."""
    period = sum(a * n for a, n in number.items())
    due = defaultdict(list)
    for a in number:
        for j in range(a):
            due[((j + 1) * period + a - 1) // a].append((j * period // a, a, j))
    free, blocks, ties = [[0, period]], [], []
    for tie, end in enumerate(sorted(due)):
        group = sorted(due[end])
        i = max(0, bisect_right(free, [group[0][0], 1 << 62]) - 1)
        open_ = []  # free ranges from the first release to the deadline
        while i < len(free) and free[i][0] < end:
            lo, hi = max(free[i][0], group[0][0]), min(free[i][1], end)
            if lo < hi:
                open_.append((lo, hi))
            i += 1
        heads, before, n = [lo for lo, _ in open_], [], 0
        for lo, hi in open_:
            before.append(n)
            n += hi - lo

        def at_most(slot: int) -> int:
            k = bisect_right(heads, slot) - 1
            return 0 if k < 0 else before[k] + min(slot, open_[k][1]) - open_[k][0]

        marks = [*(at_most(r) for r, _, _ in group), n]
        ties.append((tie, [a for _, a, _ in group], [y - x for x, y in zip(marks, marks[1:], strict=False)], before, heads))
        for k, (r, a, j) in enumerate(group):
            blocks.append((a, j, tie, k))
            _take(free, r, number[a])
    return blocks, ties


def _local(spark, rows: list[tuple], **types: pa.DataType) -> DataFrame:
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return spark.createDataFrame(pa.table({k: pa.array(list(c), t) for c, (k, t) in zip(columns, types.items(), strict=True)}))


def schedule(shares: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(source, share, period, j, offset): the slot within the period of each of a source's blocks, by earliest deadline
    first. blocks(source, blocks): how many blocks of a source are asked for; without it all of a period."""
    spark = shares.sparkSession
    long, longs = pa.int64(), pa.list_(pa.int64())
    s = shares.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(F.col("share").cast("long")).alias("share")).where("share >= 1")
    s = materialize(s.repartitionByRange(partitions(spark), "source").withColumn("b", F.spark_partition_id()), "shares")
    cells = s.groupBy("b", "share").count().collect()  # partitions * SHARE rows at most, with default shares
    number: dict[int, int] = defaultdict(int)
    for r in cells:
        number[r["share"]] += r["count"]
    kinds = {a: i for i, a in enumerate(sorted(number))}
    inside = {(r["b"], r["share"]): r["count"] for r in cells}
    before, sofar = [], [0] * len(kinds)
    for b in sorted({b for b, _ in inside}):
        before.append((b, list(sofar)))
        for a, i in kinds.items():
            sofar[i] += inside.get((b, a), 0)
    due, ties = _ties(number)
    due = _local(spark, due, share=long, j=long, tie=long, at=long)  # a row for each block of each share: SHARE * (SHARE + 1) / 2 at most
    ties = _local(spark, [(t, [kinds[a] for a in of], *x) for t, of, *x in ties], tie=long, kinds=longs, room=longs, before=longs, heads=longs)
    earlier = Window.partitionBy("b").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    ahead = [F.coalesce(F.sum((F.col("share") == a).cast("long")).over(earlier), F.lit(0)) for a in kinds]
    s = s.withColumn("_in", F.array(*ahead).cast("array<long>"))
    s = s.join(F.broadcast(_local(spark, before, b=long, _before=longs)), "b").withColumn("ahead", F.zip_with("_in", "_before", lambda x, y: x + y))
    s = s.select("source", "share", "ahead")
    s = s.withColumn("n", F.col("share")) if blocks is None else s.join(blocks, "source").withColumn("n", F.least("share", "blocks")).drop("blocks")
    s = s.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    s = s.join(F.broadcast(due.join(F.broadcast(ties), "tie")), ["share", "j"])
    # Those ahead fill the room from each release on and flow over into the next; the block takes the first place left
    # from its own release on.
    come = "(acc.over + ahead[cast(x.kinds as int)])"
    found = f"if(acc.found is null and acc.k >= at and {come} < x.room, acc.e + {come}, acc.found)"
    step = f"named_struct('over', greatest(0L, {come} - x.room), 'k', acc.k + 1L, 'e', acc.e + x.room, 'found', {found})"
    start = "named_struct('over', 0L, 'k', 0L, 'e', 0L, 'found', cast(null as bigint))"
    s = s.withColumn("p", F.expr(f"aggregate(arrays_zip(kinds, room), {start}, (acc, x) -> {step}).found"))
    s = s.withColumn("r", F.expr("array_max(filter(arrays_zip(before, heads), x -> x.before <= p))"))
    return s.select("source", "share", F.lit(sum(a * n for a, n in number.items())).cast("long").alias("period"), "j", F.expr("r.heads + p - r.before").alias("offset"))


def mix(docs: DataFrame, block: int = 16, shares: DataFrame | None = None, size: Column | None = None) -> DataFrame:
    """docs with mix_slot, mix_rank (place in the block), mix_block, mix_release and mix_deadline. docs need doc_id and
    source, and text where neither shares nor size is given."""
    if shares is None:
        shares = default_shares(docs, F.char_length("text") if size is None else size)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    d = docs.withColumn("_src", F.coalesce("source", F.lit(""))).withColumn("_key", key).withColumn("_b", F.substring("_key", 1, DIGITS))
    counts = d.groupBy("_src", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_src").alias("_s2"), F.col("_b").alias("_b2"), "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    asked = counts.groupBy(F.col("_s2").alias("source")).agg(F.expr(f"(max(_before + _n) + {block - 1}) div {block}").alias("blocks"))
    plan = schedule(shares, asked)  # no more rows than the documents have blocks
    plan = plan.groupBy(F.col("source").alias("_s3")).agg(F.max("share").alias("_share"), F.max("period").alias("_period"), F.expr("transform(sort_array(collect_list(struct(j, offset))), x -> x.offset)").alias("_offsets"))
    counts = counts.join(plan, F.col("_s2") == F.col("_s3"), "left").drop("_s3", "_n")
    within = Window.partitionBy("_src", "_b").orderBy("_key")
    d = d.withColumn("_r", F.row_number().over(within) - 1)
    d = d.join(counts, (F.col("_src") == F.col("_s2")) & (F.col("_b") == F.col("_b2")), "left")
    d = d.withColumn("_rank", F.col("_before") + F.col("_r")).withColumn("mix_block", F.expr(f"_rank div {block}"))
    d = d.withColumn("_offset", F.expr("_offsets[cast(mix_block % _share as int)]"))
    return d.select(
        *docs.columns,
        F.expr("(mix_block div _share) * _period + _offset").alias("mix_slot"),
        F.expr(f"_rank % {block}").cast("long").alias("mix_rank"),
        "mix_block",
        F.expr("(mix_block * _period) div _share").alias("mix_release"),
        F.expr("((mix_block + 1) * _period + _share - 1) div _share").alias("mix_deadline"),
    )


_SHARES = f"""
c AS (SELECT coalesce(source, '') AS source, greatest(sum(coalesce(length(text), 0)), 1) AS chars FROM documents GROUP BY 1),
s AS (SELECT source, greatest(1, floor({SHARE} * sqrt(chars / max(chars) OVER ()) + 0.5))::BIGINT AS share, row_number() OVER (ORDER BY source) AS i FROM c),
q AS (SELECT sum(share)::BIGINT AS period, list(share ORDER BY i) AS a FROM s)"""

ORACLE = f"""
WITH RECURSIVE {_SHARES.strip()},
z(t, n, p) AS (
  SELECT 0::BIGINT, list_transform(a, lambda x: 0::BIGINT), 0::BIGINT FROM q
  UNION ALL
  SELECT t + 1, list_transform(n, lambda x, i: CASE WHEN i = k THEN x + 1 ELSE x END), k FROM (
    SELECT t, n, list_min(list_filter(list_transform(n, lambda x, i: CASE WHEN (x * period) // a[i] <= t THEN {{'d': ((x + 1) * period + a[i] - 1) // a[i], 'i': i}} END), lambda y: y IS NOT NULL)).i::BIGINT AS k
    FROM z, q WHERE t < period)),
o AS (SELECT p AS i, t - 1 AS off, row_number() OVER (PARTITION BY p ORDER BY t) - 1 AS j FROM z WHERE p > 0),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(doc_id::VARCHAR)) - 1 AS r FROM documents),
b AS (SELECT r.doc_id, r.source, s.i, s.share, r // 16 AS block, r % 16 AS rank FROM r JOIN s ON s.source = coalesce(r.source, ''))
SELECT b.doc_id, b.source, ((block // share) * period + off)::BIGINT AS mix_slot, rank::BIGINT AS mix_rank, block::BIGINT AS mix_block,
  ((block * period) // share)::BIGINT AS mix_release, (((block + 1) * period + share - 1) // share)::BIGINT AS mix_deadline
FROM b CROSS JOIN q JOIN o ON o.i = b.i AND o.j = block % share"""
