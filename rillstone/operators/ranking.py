"""Ranks and prefix sums inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: About how many rows of one group share a window.
BLOCK_ROWS = 1 << 16


def block_bits(rows: int) -> int:
    """How many leading hash bits cut so many rows into blocks of about BLOCK_ROWS."""
    return max(0, (rows - 1) // BLOCK_ROWS).bit_length()


def blocked_rank(df: DataFrame, keys: list[str], unique: list[str], seed: int, out: str, rows: int | None = None) -> DataFrame:
    """Append the 0-based place of each row in its group of `keys`, in an order drawn by hash.

    The order is by a seeded 64-bit hash of the columns `unique`, then by the columns. The hash's
    leading bits cut each group into blocks, as many as the number of rows asks for (`rows`, by
    default counted; best a materialised df); the block counts are prefix-summed, and rows are
    numbered inside their block only. A group with a third of all rows thus spreads over many
    windows, and the result does not depend on the number of blocks. Null keys form a group of
    their own.
    """
    bits = block_bits(df.count() if rows is None else rows)
    order = F.xxhash64(F.lit(seed), *[F.col(c) for c in unique])
    block = F.shiftright("__h", 64 - bits) if bits else F.lit(0).cast("long")
    placed = df.withColumn("__h", order).withColumn("__b", block)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__s", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, "__b").orderBy("__h", *unique)
    numbered = placed.withColumn("__r", F.row_number().over(inside) - 1)
    same = _all([numbered[k].eqNullSafe(starts[k]) for k in keys] + [numbered["__b"] == starts["__b"]])
    ranked = numbered.join(starts, same, "inner") if keys else numbered.join(starts, "__b")
    return ranked.select(*[numbered[c] for c in df.columns], (F.col("__s") + F.col("__r")).cast("long").alias(out))


def _all(tests: list[Column]) -> Column:
    whole = tests[0]
    for t in tests[1:]:
        whole = whole & t
    return whole
