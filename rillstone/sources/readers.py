"""Readers: JSONL, Parquet, CSV, JSON documents, row slices, markdown plans, replayed judge outputs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators.merging import require_single, require_unique
from rillstone.operators.selection import row_slice
from rillstone.schemas import JUDGES

_SLICE = re.compile(r"^(.*?)@\[(-?\d*):(-?\d*)\]$")


def split_path(path: str) -> tuple[str, int | None, int | None]:
    """("file", start, stop) of "file@[start:stop]"; no bounds without the suffix."""
    m = _SLICE.match(path)
    if not m:
        return path, None, None
    return m[1], int(m[2]) if m[2] else None, int(m[3]) if m[3] else None


def found_path(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a pattern of paths, names something in the file system Spark reads from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def jsonl(spark: SparkSession, paths: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """Typed rows of one or more JSONL files; blank lines are skipped, missing files are empty.

    strict: an unreadable line fails the read; otherwise it gives a row with `_corrupt_record`.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    there = [p for p in paths if found_path(spark, p)]
    kept = schema if strict else schema + ", _corrupt_record STRING"
    if not there:
        return spark.createDataFrame([], kept)
    return spark.read.schema(kept).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(there)


def validated_jsonl(spark: SparkSession, paths: str | list[str], schema: str, key: str = "id") -> DataFrame:
    """As jsonl, failing on a key that stands twice over all files."""
    return require_unique(jsonl(spark, paths, schema), key)


def single_mechanism(df: DataFrame, mechanism: str | None = None) -> DataFrame:
    """df, checked to have rows of one mechanism."""
    return require_single(df, "mechanism", mechanism)


def partitioned(spark: SparkSession, root: str, schema: str, mechanisms: tuple[str, ...] = ("EIL", "MIU"), splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Rows of root/{mechanism}/{split}.jsonl with the partition they were found in (stored_as)."""
    out = None
    for m in mechanisms:
        for s in splits:
            part = jsonl(spark, f"{root}/{m}/{s}.jsonl", schema).withColumn("stored_as", F.lit(f"{m}/{s}"))
            out = part if out is None else out.unionByName(part)
    return out


def any_table(spark: SparkSession, path: str, order: list[str] | None = None) -> DataFrame:
    """A Parquet, JSONL, JSON (a list, or an object with a list) or CSV file, by its suffix.

    path@[a:b] takes rows a to b in the given order, or in the order of the file's rows.
    """
    file, start, stop = split_path(path)
    suffix = file.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        df = spark.read.parquet(file)
    elif suffix in ("jsonl", "ndjson"):
        df = spark.read.json(file)
    elif suffix == "json":
        df = spark.read.option("multiLine", True).json(file)
        lists = [c for c, t in df.dtypes if t.startswith("array<struct")]
        if len(df.columns) <= 3 and lists:
            df = df.select(F.explode(lists[0]).alias("r")).select("r.*")
    elif suffix in ("csv", "tsv"):
        df = spark.read.option("header", True).option("sep", "\t" if suffix == "tsv" else ",").option("multiLine", True).csv(file)
    else:
        raise ValueError(f"no reader for .{suffix}")
    if start is None and stop is None:
        return df
    if order:
        return row_slice(df, order, start, stop)
    placed = df.select("*", F.monotonically_increasing_id().alias("__row"))
    return row_slice(placed, ["__row"], start, stop).drop("__row")


def found_files(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, length, sha256) of all files below root with one of the suffixes, by name."""
    glob = "*{" + ",".join(suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path")


def plan_blocks(spark: SparkSession, path: str, fence: str = "text", expected: int | None = None) -> DataFrame:
    """(index, heading, target_count, text) of the fenced blocks of a markdown plan.

    The target count is the number in "Create one <family> record ... one of N"; the heading is
    the nearest one above the block. expected: how many blocks there must be.
    """
    whole = spark.read.text(path, wholetext=True)
    block = rf"(?s)(?:^|\n)#+ ([^\n]*)\n(?:(?!\n#+ ).)*?(?:```|~~~){fence}\n(.*?)(?:```|~~~)"
    found = whole.select(F.arrays_zip(F.regexp_extract_all("value", F.lit(block), F.lit(1)).alias("heading"), F.regexp_extract_all("value", F.lit(block), F.lit(2)).alias("text")).alias("b"))
    rows = found.select(F.posexplode("b").alias("pos", "b")).select((F.col("pos") + 1).alias("index"), "b.heading", F.col("b.text").alias("text"))
    rows = rows.withColumn("target_count", F.try_to_number(F.nullif(F.regexp_extract("text", r"(?is)create one english record.*?one of\s+(\d+)", 1), F.lit("")), F.lit("999999")).cast("int"))
    if expected is not None and rows.count() != expected:
        raise ValueError(f"expected {expected} blocks")
    return rows.select("index", "heading", "target_count", "text")


def judged(df: DataFrame, column: str, kind: str, out: str = "judged") -> DataFrame:
    """A judge's JSON text as a struct, code fences off; `problem` names why it is null."""
    body = F.regexp_replace(F.trim(column), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    parsed = F.from_json(body, JUDGES[kind])
    first = F.col(out)[JUDGES[kind][7:].split(":", 1)[0]]
    rows = df.withColumn(out, parsed)
    return rows.withColumn("problem", F.when(F.col(column).isNull(), "missing").when(~F.startswith(F.trim(body), F.lit("{")), "not_an_object").when(first.isNull(), "wrong_keys"))


def flexible_field(df: DataFrame, *names: str) -> Column:
    """The first non-empty of columns matched without regard to case, blanks and underscores."""
    plain = {re.sub(r"[\s_]+", "", c).lower(): c for c in df.columns}
    have = [plain[k] for n in names if (k := re.sub(r"[\s_]+", "", n).lower()) in plain]
    return F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in have]) if have else F.lit(None).cast("string")


def choice_list(df: DataFrame, column: str | None = None) -> Column:
    """Options as array<string>: of a list column, a map's values, or columns A, B, C ..."""
    if column and column in df.columns:
        kind = dict(df.dtypes)[column]
        if kind.startswith("array"):
            return F.transform(column, lambda x: x.cast("string"))
        if kind.startswith("map"):
            return F.map_values(column)
        if kind.startswith("struct"):
            return F.array(*[F.col(f"{column}.{f.name}").cast("string") for f in df.schema[column].dataType.fields])
    return F.array_compact(F.array(*[F.col(c) for c in "ABCDEFGH" if c in df.columns]))
