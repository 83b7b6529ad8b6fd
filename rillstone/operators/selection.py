"""Quotas, schedules, balanced assignment, best rows and newest groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions.hashing import joined, seed64
from rillstone.operators.ranking import blocked_rank
from rillstone.session import materialize


def quota_count(total: int, share: float) -> int:
    """The nearest whole quota, halves up."""
    if total < 1 or not 0.0 < share < 1.0:
        raise ValueError("total must be positive and share strictly between 0 and 1")
    return int(total * share + 0.5)


def task_schedule(ids: DataFrame, id_col: str, seed: int, share: float, total: int, first: str = "EIL", other: str = "MIU") -> DataFrame:
    """Give `first` its exact quota of `total` ids, spaced evenly from a hashed phase."""
    q = quota_count(total, share)
    phase = seed64(F.lit(f"{seed}:mixed-task-phase-v1")).cast("double") / F.lit(2.0**64)
    upto = lambda i: F.floor(i * F.lit(float(q)) / F.lit(float(total)) + phase)
    i = F.col(id_col).cast("double")
    return ids.withColumn("task", F.when(upto(i + 1) > upto(i), first).otherwise(other))


def hashed_task(id_col: str, seed: int, share: float, first: str = "EIL", other: str = "MIU") -> Column:
    """The task of an id by a hashed draw, where no total is known."""
    draw = seed64(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"), F.lit(":mixed-task-v1"))).cast("double") / F.lit(2.0**64)
    return F.when(draw < share, first).otherwise(other)


def largest_remainder(total: Column, shares: dict[str, float]) -> Column:
    """Whole quotas of a total as map<string,bigint>: floors, then the largest remainders, then by place."""
    parts = [F.struct((total * s - F.floor(total * s)).alias("rest"), F.lit(-i).alias("at"), F.floor(total * s).cast("long").alias("whole"), F.lit(n).alias("name")) for i, (n, s) in enumerate(shares.items())]
    ordered = F.sort_array(F.array(*parts), asc=False)
    missing = total - F.aggregate(ordered, F.lit(0).cast("long"), lambda a, x: a + x["whole"])
    entries = F.transform(ordered, lambda x, i: F.struct(x["name"].alias("key"), (x["whole"] + (i < missing).cast("long")).alias("value")))
    return F.map_from_entries(entries)


def balanced_labels(df: DataFrame, by: list[str], key: str, labels: list[str], out: str = "target") -> DataFrame:
    """Deal labels evenly within each group: quotas differ by one at most, extras and order by hash.

    Rows are ranked in blocks of a hashed order; the label comes from the rank by arithmetic, so a
    group of any size is balanced without one task holding it.
    """
    ranked = blocked_rank(materialize(df, "unlabelled"), by, [key], 17, "__rank")
    ordered = F.sort_array(F.array(*[F.struct(seed64(joined(*by, F.lit("target"), F.lit(x))).alias("h"), F.lit(x).alias("label")) for x in labels]))
    return ranked.withColumn(out, F.element_at(ordered, (F.col("__rank") % len(labels)).cast("int") + 1)["label"]).drop("__rank")


def target_flow(b: list[Column], q: list[Column], pick: Column) -> dict[str, Column]:
    """Flows n_ij (i from, j to, i != j) of a 3 x 3 table without diagonal, with row sums b and column
    sums q: one free cell, chosen by `pick` within its bounds, fixes the other five."""
    lower = F.greatest(F.lit(0), q[1] - b[2], q[0] + q[1] - b[1] - b[2])
    upper = F.least(b[0], q[1], q[0] - b[2] + q[1])
    n12 = lower + (pick % (upper - lower + 1)).cast("long")
    n32 = q[1] - n12
    n31 = b[2] - n32
    n21 = q[0] - n31
    return {"n12": n12, "n13": b[0] - n12, "n21": n21, "n23": b[1] - n21, "n31": n31, "n32": n32}


def first_by_hash(df: DataFrame, by: list[str], key: str, n: int, salt: str) -> DataFrame:
    """The first n rows of each group in a hashed order; Spark keeps only n per group before the shuffle."""
    top = Window.partitionBy(*by).orderBy("__h", key)
    return df.withColumn("__h", seed64(joined(F.lit(salt), key))).withColumn("__n", F.row_number().over(top)).where(F.col("__n") <= n).drop("__h", "__n")


def newest_groups(df: DataFrame, group: str, time: str, n: int) -> DataFrame:
    """All rows of the n groups with the latest member; groups without a time come last, ties by name."""
    chosen = df.groupBy(group).agg(F.max(time).alias("__t")).orderBy(F.col("__t").desc_nulls_last(), group).limit(n)
    return df.join(chosen.select(group), group, "left_semi")


def best_step(df: DataFrame, step: str, parts: dict[str, Column], weights: dict[str, float], gate: Column) -> DataFrame:
    """The first step of highest weighted mean among those that pass the gate; a null part leaves a step out."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must sum to a positive value")
    score = sum((parts[k] * w for k, w in weights.items()), F.lit(0.0)) / total
    return df.where(gate).withColumn("score", score).where("score is not null").orderBy(F.col("score").desc(), step).limit(1)


def with_deltas(df: DataFrame, order: str, fields: list[str], flipped: tuple[str, ...] = (), by: list[str] = ()) -> DataFrame:
    """Step-over-step differences (negated for `flipped`); null where either side is."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.select("*", *[((F.col(f) - F.lag(f).over(w)) * (-1 if f in flipped else 1)).alias(f"delta_{f}") for f in fields])


def with_position(df: DataFrame, order: list[str], out: str = "__pos") -> DataFrame:
    """0-based positions in a total order: rows are ranged into sorted partitions, counted, and offset.

    The sorted ranges are materialised with each row's place in its range, so that counts and places
    always come from one and the same cut. Rows equal in all of `order` stand in any order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The high bits of this number are the range, the low 33 the place in it.
    kept = materialize(ranged.withColumn("__m", F.monotonically_increasing_id()), "ranged")
    placed = kept.withColumn("__p", F.shiftright("__m", 33))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    starts = placed.groupBy("__p").count().select(F.col("__p").alias("__q"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__s"))
    placed = placed.join(F.broadcast(starts), F.col("__p") == F.col("__q"))
    return placed.select(*df.columns, (F.col("__s") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias(out))


def shard(df: DataFrame, order: list[str], index: int, count: int) -> DataFrame:
    """Every count-th row of a total order, from index on."""
    return with_position(df, order).where(F.col("__pos") % count == index).drop("__pos")


def row_slice(df: DataFrame, order: list[str], start: int | None, stop: int | None) -> DataFrame:
    """Rows start:stop of a total order; negative bounds count from the end, as in Python."""
    placed = with_position(df, order)
    if (start or 0) < 0 or (stop or 0) < 0:
        n = df.count()
        start = None if start is None else max(0, n + start) if start < 0 else start
        stop = None if stop is None else max(0, n + stop) if stop < 0 else stop
    keep = F.col("__pos") >= (start or 0)
    return placed.where(keep if stop is None else keep & (F.col("__pos") < stop)).drop("__pos")


def trim_to_multiple(df: DataFrame, order: list[str], batch: int) -> DataFrame:
    """Drop the tail beyond the last full batch of a total order."""
    return row_slice(df, order, 0, df.count() // batch * batch)


def replicated(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """n copies of each row with group_index (its position) and a running index."""
    placed = with_position(df, order, "group_index")
    return placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("copy")).withColumn("index", F.col("group_index") * n + F.col("copy")).drop("copy")


def seeded_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A permutation by hash: the same rows and seed always give the same order."""
    return df.orderBy(seed64(joined(F.lit(str(seed)), key)), key)
