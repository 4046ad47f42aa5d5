"""Running figures along an order, where one key may hold most rows.

A window over a key is one task for that key, and costs one shuffle. So keys of up to HOT rows go by windows. Rows of other
keys are dealt out by ranges of (key, order), each range sums by itself, and the few rows of (key, range) carry the starts
over. A key of any size is spread over as many tasks as it has ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.session import materialize


#: Rows of a key that one task takes in order.
HOT = 200_000


def along(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str], before: dict[str, str] | None = None, counted: DataFrame | None = None, whole: dict[str, str] | None = None) -> DataFrame:
    """rows with, for each name of sums, the sum of its expression over all rows of the key up to and with this one, for
    each name of before the value of its column in the row before (null in the first), and for each name of whole the sum
    of its expression over all rows of the key. Rows that order cannot tell
    apart come in any order, but the same for all figures. counted: rows that have the same keys at least as often, where
    those are cheaper to count."""
    before, whole, keys, order = before or {}, whole or {}, list(keys), list(order)
    many = (rows if counted is None else counted).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_n"))
    many = many.where(F.col("_n") > HOT).drop("_n")
    if many.isEmpty():
        return _by_key(rows, keys, order, sums, before, whole)
    many = materialize(many, "hot")  # one row for HOT rows of the table at most
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return _by_key(rows.join(many, same, "left_anti"), keys, order, sums, before, whole).unionByName(_by_range(rows.join(many, same, "left_semi"), keys, order, sums, before, whole))


def _by_key(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], before: dict[str, str], whole: dict[str, str]) -> DataFrame:
    """along() by one window a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # the same order: no second sort
    return rows.select(
        "*", *[F.sum(F.expr(e)).over(upto).alias(n) for n, e in sums.items()], *[F.lag(c).over(w).alias(n) for n, c in before.items()],
        *[F.sum(F.expr(e)).over(every).alias(n) for n, e in whole.items()],
    )


def _by_range(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], before: dict[str, str], whole: dict[str, str]) -> DataFrame:
    """along() by ranges of (key, order)."""
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "stretches")
    inner = Window.partitionBy(*keys, "_range").orderBy("_at")
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = dealt.groupBy(*keys, "_range").agg(
        *[F.sum(F.expr(e)).alias(f"_s_{n}") for n, e in (sums | whole).items()],
        *[F.max_by(c, "_at").alias(f"_l_{n}") for n, c in before.items()],
    )
    outer = Window.partitionBy(*keys).orderBy("_range")
    starts = each.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(f"_s_{n}").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.lag(f"_l_{n}").over(outer).alias(f"_p_{n}") for n in before],
        *[F.sum(f"_s_{n}").over(Window.partitionBy(*keys)).alias(f"_w_{n}") for n in whole],
    )
    # Null keys are keys too.
    named = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), *[c for c in starts.columns if c.startswith(("_o_", "_p_", "_w_"))])
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    first = F.row_number().over(inner) == 1
    d = dealt.join(named, same)
    return d.select(
        *rows.columns,
        *[(F.sum(F.expr(e)).over(upto) + F.col(f"_o_{n}")).alias(n) for n, e in sums.items()],
        *[F.when(first, F.col(f"_p_{n}")).otherwise(F.lag(c).over(inner)).alias(n) for n, c in before.items()],
        *[F.col(f"_w_{n}").alias(n) for n in whole],
    )
