"""Session helpers: building a local session, and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rillstone")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def importable_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package must stand at the same place on every node or be shipped with the
    session (spark.submit.pyFiles); a path that is missing there does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH"))))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="rillstone-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return own


_own_folders: set[str] = set()


def own_folder(spark: SparkSession) -> str:
    """Where this application's tables stand. It is deleted when the driver's Python ends in the usual way."""
    folder = f"{shared_folder(spark)}/rillstone-{spark.sparkContext.applicationId}"
    if folder not in _own_folders:
        _own_folders.add(folder)
        atexit.register(_delete, spark._jvm.org.apache.hadoop.fs.Path(folder), spark._jsc.hadoopConfiguration())
    return folder


def _delete(path, configuration) -> None:
    try:
        path.getFileSystem(configuration).delete(path, True)
    except Exception:  # the JVM may have gone first; then the folder stays
        pass


def forget(spark: SparkSession) -> None:
    """Delete the tables this application has materialised; call it between jobs once their results are written."""
    _delete(spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark)), spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df once as a table in the shared folder and read it back.

    Later plans start from the files, so they survive the loss of any executor, and
    the planner sees the true size before it decides on a broadcast.
    """
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stands_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialised table that no later step reads."""
    spark = df.sparkSession
    _delete(spark._jvm.org.apache.hadoop.fs.Path(df._stands_at), spark._jsc.hadoopConfiguration())


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for Python work on a scan of few files.

    A scan that already has them stays as it is, so large tables are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
