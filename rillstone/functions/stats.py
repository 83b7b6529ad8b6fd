"""Statistics over DataFrames, two-level where a level can pre-aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.session import materialize


def digest(key: Column) -> Column:
    """16 bytes that stand for a text of any length."""
    return F.unhex(F.md5(key.cast("string")))


def duplicate_excess(df: DataFrame, key: Column, out: str = "excess") -> DataFrame:
    """How many rows are repetitions of an earlier equal key. The keys meet by a digest of 128 bits, not as whole texts."""
    return df.groupBy(digest(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(out))


def distribution(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Observations, support, exp(entropy), normalised entropy and dominance of a value, per group.

    Nulls count as a value of their own, written "None". Normalised entropy is 1 for one value.
    """
    by = list(by)
    n = df.groupBy(*by, F.coalesce(F.col(value).cast("string"), F.lit("None")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    whole = n.groupBy(*by).agg(F.sum("n").alias("observations"), F.count(F.lit(1)).alias("support"), F.max("n").alias("top"), F.sum(F.col("n") * F.ln("n")).alias("nln"))
    entropy = F.ln("observations") - F.col("nln") / F.col("observations")
    return whole.select(
        *by, "observations", "support", F.bround(F.exp(entropy), 3).alias("effective_support"),
        F.when(F.col("support") > 1, F.bround(F.try_divide(entropy, F.ln("support")), 4)).otherwise(F.lit(1.0)).alias("normalized_entropy"), F.bround(F.col("top") / F.col("observations"), 4).alias("dominance"),
    )


def nmi(df: DataFrame, left: str, right: str, by: list[str] = ()) -> DataFrame:
    """Normalised mutual information per group; null where a side has fewer than two values.

    One pass counts the pairs; the margins come from those counts.
    """
    by = list(by)
    pairs = df.groupBy(*by, F.col(left).alias("x"), F.col(right).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    h = lambda c: F.sum(F.col(c) * F.ln(c))
    side = lambda c: pairs.groupBy(*by, c).agg(F.sum("n").alias("m")).groupBy(*by).agg(h("m").alias(f"s{c}"), F.count(F.lit(1)).alias(f"k{c}"))
    joint = pairs.groupBy(*by).agg(F.sum("n").alias("total"), h("n").alias("sxy"))
    if by:
        on = by
        rows = joint.join(side("x"), on).join(side("y"), on)
    else:  # one row each
        rows = joint.join(F.broadcast(side("x"))).join(F.broadcast(side("y")))
    t = F.col("total")
    hx, hy = F.ln(t) - F.col("sx") / t, F.ln(t) - F.col("sy") / t
    mutual = F.ln(t) + (F.col("sxy") - F.col("sx") - F.col("sy")) / t
    return rows.select(*by, F.col("total").alias("records"), F.when((F.col("kx") > 1) & (F.col("ky") > 1), mutual / F.sqrt(hx * hy)).alias("nmi"))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def cumulated(n: DataFrame, by: list[str], order: str, weight: str) -> DataFrame:
    """n with `upto`, the running sum of the weight in the order within the group, and `total`, the group's sum.

    The rows are ranged over all groups and materialised with the number of their range; running sums
    stay within a range, and what stands before it, one row per group and range, is added. A group of
    any size thus spreads over many tasks. The order's values must be distinct within a group.
    """
    ranged = n.repartitionByRange(*by, order).sortWithinPartitions(*by, order).withColumn("__p", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    sums = ranged.groupBy(*by, "__p").agg(F.sum(weight).alias("__w"))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("__o", F.coalesce(F.sum("__w").over(before), F.lit(0))).withColumn("total", F.sum("__w").over(Window.partitionBy(*by)))
    local = ranged.withColumn("upto", F.sum(weight).over(Window.partitionBy("__p", *by).orderBy(order)))
    both = local.join(carried, _same(local, carried, [*by, "__p"]))
    return both.select(*[local[c] for c in n.columns], (F.col("upto") + F.col("__o")).alias("upto"), "total")


def _ordered_values(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    n = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return cumulated(n, by, "v", "n")


def _at(place: Column) -> Column:
    """The value at a place from 0, as an aggregate over ordered values."""
    return F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("n") <= place), F.col("v")))


def nearest_ranks(df: DataFrame, value: str, quantiles: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Per group the values at the places round((n - 1) q), rounding half to even, to 4 places, from cumulated counts of
    the distinct values. Nulls are left out."""
    by = list(by)
    found = [F.bround(_at(F.bround((F.col("total") - 1) * F.lit(q), 0)), 4).alias(c) for c, q in quantiles.items()]
    return _ordered_values(df, value, by).groupBy(*by).agg(*found)


def nearest_rank(df: DataFrame, value: str, q: float, by: list[str] = (), out: str = "value") -> DataFrame:
    """One quantile of nearest_ranks."""
    return nearest_ranks(df, value, {out: q}, by)


def describe(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Count, mean, population deviation and interpolated quartiles per group, from cumulated counts of the distinct values."""
    by = list(by)
    moments = df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    parts = []
    for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        place = (F.col("total") - 1) * F.lit(q)
        parts += [_at(F.floor(place)).alias(f"{name}_lo"), _at(F.ceil(place)).alias(f"{name}_hi"), F.max(place - F.floor(place)).alias(f"{name}_part")]
    places = _ordered_values(df, value, by).groupBy(*by).agg(*parts)
    both = moments.join(places, _same(moments, places, by), "left")
    quartile = lambda c: (F.col(f"{c}_lo") + (F.col(f"{c}_hi") - F.col(f"{c}_lo")) * F.col(f"{c}_part")).alias(c)
    return both.select(*[moments[c] for c in by], "count", "mean", "std", *map(quartile, ("p25", "p50", "p75")))


def average_rank(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Rank with ties at their average, from cumulated counts of distinct values."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    ranks = cumulated(n, by, value, "__n").select(*by, value, (F.col("upto") - (F.col("__n") - 1) / 2.0).alias(out))
    return df.join(ranks, [*by, value])


def spearman(df: DataFrame, left: str, right: str, by: list[str] = ()) -> DataFrame:
    """Rank correlation with average ties; null where a side does not vary. Rows with a null are left out."""
    by = list(by)
    rows = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*by, left, right)
    ranked = average_rank(average_rank(rows, left, by, "__x"), right, by, "__y")
    r = F.when((F.stddev_pop("__x") > 0) & (F.stddev_pop("__y") > 0), F.corr("__x", "__y"))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r.alias("spearman"))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n - c, k) / C(n, k), as the running product over n - c + 1 .. n."""
    terms = F.transform(F.sequence(n - c + 1, n), lambda i: 1 - F.lit(float(k)) / i)
    return F.when(n - c < k, F.lit(1.0)).when(c <= 0, F.lit(0.0)).otherwise(1 - F.aggregate(terms, F.lit(1.0), lambda a, x: a * x))


def mapped_share(df: DataFrame, tag_lists: str, by: str) -> DataFrame:
    """(grp, fields, unmapped, mapped_rate): fields, those tagged only "other", and the share of the rest to 4
    places, overall and by group; no share without fields."""
    n = F.coalesce(F.size(tag_lists), F.lit(0))
    other = F.coalesce(F.size(F.filter(tag_lists, lambda t: F.array_join(t, "|") == "other")), F.lit(0))
    found = df.select(by, n.alias("n"), other.alias("o")).cube(by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("fields"), F.coalesce(F.sum("o"), F.lit(0)).alias("unmapped"), F.grouping_id().alias("g"))
    rate = F.bround(F.try_divide(F.col("fields") - F.col("unmapped"), F.col("fields")), 4)
    return found.select(F.when(F.col("g") == 1, F.lit("(all)")).otherwise(F.coalesce(by, F.lit("(null)"))).alias("grp"), "fields", "unmapped", rate.alias("mapped_rate"))


def incidence(df: DataFrame, tag_lists: str, by: str) -> DataFrame:
    """Tag counts, overall ("(all)") and by group, in one pass; mapped_share has the share of mapped fields."""
    fields = df.select(by, F.explode(tag_lists).alias("field"))
    counts = fields.select(by, F.explode("field").alias("tag")).cube(by, "tag").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")).where("g in (0, 2)")
    return counts.select(F.when(F.col("g") == 2, F.lit("(all)")).otherwise(F.coalesce(by, F.lit("(null)"))).alias("grp"), "tag", "n")
