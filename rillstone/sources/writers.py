"""Writers: refuse to overwrite, append what is absent, swap whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.operators.merging import append_absent


def write_release(df: DataFrame, path: str, by: tuple[str, ...] = ("mechanism", "split")) -> None:
    """Write a release partitioned by its keys; an existing target is an error."""
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)


def append_once(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table does not hold yet; returns how many. A repeated call adds none."""
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # the table does not exist yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        old = spark.createDataFrame([], df.schema)
    new = append_absent(df, old, key).persist()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def write_as(df: DataFrame, path: str) -> None:
    """JSONL, CSV or zstd Parquet by suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("jsonl", "json"):
        df.write.mode("errorifexists").json(path)
    elif suffix == "csv":
        df.write.mode("errorifexists").option("header", True).csv(path)
    elif suffix == "parquet":
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    else:
        raise ValueError(f"no writer for .{suffix}")


def csv_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in order: others dropped, absent ones null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def swap_table(df: DataFrame, path: str, staging: str) -> None:
    """Write to staging and put it in the target's place by renaming.

    A failed write leaves the target as it is; between the two renames the old table stands beside
    the target with the ending .old, and it is put back where the second rename fails. df may read the
    target itself. Staging must be in the target's file system.
    """
    df.write.mode("overwrite").parquet(staging)
    spark = df.sparkSession
    new, target, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staging, path, path.rstrip("/") + ".old"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    held = fs.exists(target)
    if held and not fs.rename(target, old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(new, target):
        if held:
            fs.rename(old, target)
        raise OSError(f"cannot put {staging} in the place of {path}")
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def write_dump(df: DataFrame, path: str) -> None:
    """Rollout samples partitioned by rollout and kind, for later scans by partition."""
    df.write.mode("append").partitionBy("rollout_id", "kind").parquet(path)
