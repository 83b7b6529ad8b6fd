"""Joins along time that hold for keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.session import materialize


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, out: str = "asof") -> DataFrame:
    """Each left row with the right row of its key that is the latest at or before its time, as struct `out`.

    Both sides stand in one order by key and time, ranged over all keys, so that a key with a third of
    the rows spreads over many tasks; within a range the last right row is carried along, and at its
    begin the last one of the ranges before, one row per key and range. Of right rows of one time the
    greatest counts. Left rows with a null key or time, and those before any right row, have null; right
    rows with a null key or time are left out. A right column may be named as a left one.
    """
    row = F.struct(*[F.col(c) for c in right.columns])
    kind = right.select(row.alias("r")).schema["r"].dataType
    ours = left.select(F.col(key).alias("__k"), F.col(time).alias("__t"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__left"), F.lit(None).cast(kind).alias("__right"))
    theirs = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("__k"), F.col(time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(ours.schema["__left"].dataType).alias("__left"), row.alias("__right"))
    ranged = materialize(ours.unionByName(theirs).repartitionByRange("__k", "__t").withColumn("__p", F.spark_partition_id()), "timeline")
    inside = Window.partitionBy("__p", "__k").orderBy("__t", "__side", "__right").rowsBetween(Window.unboundedPreceding, 0)
    here = ranged.withColumn("__here", F.last("__right", ignorenulls=True).over(inside))
    ends = ranged.where("__side = 0").groupBy("__k", "__p").agg(F.max(F.struct("__t", "__right")).alias("e")).select(F.col("__k").alias("__ek"), F.col("__p").alias("__ep"), F.col("e.__right").alias("__end"))
    # One row per key and range that holds a left row of the key.
    wanted = ranged.where("__side = 1 and __k is not null").select("__k", "__p").distinct()
    spots = wanted.select("__k", "__p").unionByName(ends.select(F.col("__ek").alias("__k"), F.col("__ep").alias("__p"))).distinct()
    before = Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.join(ends, (F.col("__k") == F.col("__ek")) & (F.col("__p") == F.col("__ep")), "left").withColumn("__before", F.last("__end", ignorenulls=True).over(before)).select(F.col("__k").alias("__ck"), F.col("__p").alias("__cp"), "__before")
    rows = here.where("__side = 1").join(carried, (F.col("__k") == F.col("__ck")) & (F.col("__p") == F.col("__cp")), "left")
    return rows.select("__left.*", F.when(F.col("__t").isNotNull(), F.coalesce("__here", "__before")).alias(out))
