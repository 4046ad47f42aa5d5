"""Name search over an index: sorted names, and lists of the names that hold each trigram.

Equal names and prefixes are ranges of the sorted names. A substring of three characters or more is looked up by its
rarest trigrams: their lists are read, met and verified, and no other name is read. Lists are dealt out by buckets of
their trigram (a lookup opens a few folders) and within a bucket by ranges of (trigram, name), so the list of a trigram that
every name holds is spread over many files. Shorter texts have no trigram and scan the names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders of the lists, and the most lists that one search reads: what they leave is verified on the names themselves.
BUCKETS, MOST_LISTS = 64, 3
META = frozenset("*?[]")


def folded(name: Column) -> Column:
    """Case does not matter to a substring."""
    return F.lower(name)


def grams_of(text: str) -> list[str]:
    t = text.lower()
    return sorted({t[i : i + 3] for i in range(len(t) - 2)})


def bucket(gram: Column) -> Column:
    return (F.crc32(gram.cast("binary")) % BUCKETS).cast("int")


def names(nodes: DataFrame) -> DataFrame:
    """(node, layer): each name once, with its coarsest layer."""
    return nodes.groupBy("node").agg(F.min("layer").alias("layer"))


def postings(named: DataFrame) -> DataFrame:
    """(bucket, gram, node, layer): the lists, each name once in each."""
    n = folded(F.col("node"))
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(n) - 2, F.lit(0)))
    grams = F.when(F.char_length(n) >= 3, F.array_distinct(F.transform(starts, lambda i: F.substring(n, i, F.lit(3)))))
    d = named.select("node", "layer", F.explode(grams).alias("gram"))
    return d.select(bucket(F.col("gram")).alias("bucket"), "gram", "node", "layer")


def frequencies(lists: DataFrame) -> DataFrame:
    """(gram, n): how long each list is."""
    return lists.groupBy("gram").agg(F.count("*").alias("n"))


def containing(named: DataFrame, lists: DataFrame, sizes: DataFrame, text: str) -> DataFrame:
    """(node, layer) of the names that hold text, in any case."""
    holds = F.contains(folded(F.col("node")), F.lit(text.lower()))
    grams = grams_of(text)
    if not grams:
        return named.where(holds).select("node", "layer")
    known = {r.gram: r.n for r in sizes.where(F.col("gram").isin(grams)).collect()}  # one row for each trigram of the text
    if len(known) < len(grams):
        return named.where(F.lit(False)).select("node", "layer")
    rare = sorted(grams, key=lambda g: (known[g], g))[:MOST_LISTS]
    local = named.sparkSession.createDataFrame([(g,) for g in rare], "gram string").select(bucket(F.col("gram")).alias("b")).distinct()
    at = [r.b for r in local.collect()]
    read = lists.where(F.col("bucket").isin(at) & F.col("gram").isin(rare) & holds)
    return read.groupBy("node").agg(F.count("*").alias("n"), F.first("layer").alias("layer")).where(F.col("n") == len(rare)).select("node", "layer")


def search(named: DataFrame, lists: DataFrame, sizes: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """(node, layer, stage) of at most `limit` names: those equal to text (0), else those that begin with it (1, unless it
    holds one of * ? [ ]), else those that hold it in any case (2). A stage is only read if those before found nothing."""
    n = F.col("node")
    stages = [named.where(n == text)]
    if not META & set(text):
        stages.append(named.where(F.startswith(n, F.lit(text))))
    for stage, found in zip((0, 1), stages, strict=False):
        top = found.select("node", "layer", F.lit(stage).cast("long").alias("stage"))
        if not top.isEmpty():
            return top.orderBy("node").limit(limit)
    return containing(named, lists, sizes, text).select("node", "layer", F.lit(2).cast("long").alias("stage")).orderBy("node").limit(limit)
