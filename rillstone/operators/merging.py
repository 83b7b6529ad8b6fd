"""Keyed merges, resumable writes, integrity checks: joins that state their contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once, with their count; an empty result means unique."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """df, after checking that the key is unique."""
    twice = duplicate_keys(df, key).limit(5).collect()
    if twice:
        raise ValueError(f"repeated {key}: {[r[key] for r in twice]}")
    return df


def require_single(df: DataFrame, column: str, value: str | None = None) -> DataFrame:
    """df, after checking that it has rows and one value of the column (the given one)."""
    seen = [r[0] for r in df.select(column).distinct().limit(2).collect()]
    if len(seen) != 1 or (value is not None and seen[0] != value):
        raise ValueError(f"{column} should be one value{f' {value!r}' if value else ''}, not {seen}")
    return df


def pending(every: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not yet done."""
    return every.join(done.select(key).distinct(), key, "left_anti")


def heldout(test: DataFrame, train: DataFrame, value: str) -> DataFrame:
    """The distinct values of the test rows that no training row has; nulls are left out."""
    return pending(test.select(value).where(F.col(value).isNotNull()).distinct(), train, value)


def append_absent(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """The new rows whose key is not in the old ones, each key once: an idempotent append."""
    return pending(new.dropDuplicates([key]), old, key)


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows with those of equal key replaced whole; the others as they were. New keys of no old row are left out."""
    n = new.select(F.col(key).alias("__k"), F.struct(*[F.col(c) for c in old.columns]).alias("__new"))
    merged = old.join(n, F.col(key) == F.col("__k"), "left")
    return merged.select(*[F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) for c in old.columns])


def patched(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Old rows with the named columns taken from new where it has a value (retry merge)."""
    n = new.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    rows = old.join(n, F.col(key) == F.col("__k"), "left")
    return rows.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def conflicts(current: DataFrame, base: DataFrame, key: str, frozen: list[str]) -> DataFrame:
    """Keys on one side only, or whose frozen columns differ: (key, problem). Nulls equal nulls."""
    a = current.select(F.col(key).alias("a_key"), *[F.col(c).alias(f"a_{c}") for c in frozen])
    b = base.select(F.col(key).alias("b_key"), *[F.col(c).alias(f"b_{c}") for c in frozen])
    same = reduce(lambda x, y: x & y, [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in frozen], F.lit(True))
    both = a.join(b, F.col("a_key") == F.col("b_key"), "full_outer")
    problem = F.when(F.col("a_key").isNull(), "missing").when(F.col("b_key").isNull(), "unexpected").when(~same, "changed")
    return both.select(F.coalesce("a_key", "b_key").alias(key), problem.alias("problem")).where("problem is not null")


def optimistic_merge(current: DataFrame, accepted: DataFrame, key: str, digest: str, columns: list[str]) -> DataFrame:
    """Patch the accepted rows, after checking that the digest each was derived from still stands."""
    stale = accepted.join(current.select(F.col(key).alias("__k"), F.col(digest).alias("__d")), F.col(key) == F.col("__k"), "left").where(~F.col(digest).eqNullSafe(F.col("__d")))
    bad = stale.select(key).limit(5).collect()
    if bad:
        raise ValueError(f"changed since: {[r[key] for r in bad]}")
    return patched(current, accepted, key, columns)


def covered(parts: list[DataFrame], whole: DataFrame, key: str) -> DataFrame:
    """The union of the parts, joined with the whole, after checking that they cover it exactly once."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    require_unique(union, key)
    if conflicts(union, whole, key, []).limit(1).collect():
        raise ValueError("the parts do not cover the whole")
    return union.join(whole, key)


def quarantined(df: DataFrame, issues: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with an issue, the others); a null key is a key like any other."""
    bad = issues.select(F.col(key).alias("__k")).distinct()
    same = F.col(key).eqNullSafe(F.col("__k"))
    return df.join(bad, same, "left_semi"), df.join(bad, same, "left_anti")


def namespaced(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Union of frames with "name:" put before their keys; missing columns are null."""
    frames = [d.withColumn(key, F.concat(F.lit(f"{n}:"), F.col(key).cast("string"))) for n, d in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def task_of(label: Column | str) -> Column:
    """The namespace of a label, null without one."""
    return F.nullif(F.regexp_extract(label, "^([A-Z]+):", 1), F.lit(""))


def single_task_groups(df: DataFrame, group: str, label: str) -> DataFrame:
    """Each group with its one task; a group with none or several has null."""
    t = df.groupBy(group).agg(F.min(task_of(label)).alias("lo"), F.max(task_of(label)).alias("hi"), F.count_if(task_of(label).isNull()).alias("none"))
    return t.select(group, F.when((F.col("lo") == F.col("hi")) & (F.col("none") == 0), F.col("lo")).alias("task"))
