"""Seeds, buckets and hash orders as columns: all from SHA-256, so stable across engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Like = Column | str


def joined(*parts: Like | int, sep: str = "|") -> Column:
    """The parts as one text; numbers and columns alike."""
    return F.concat_ws(sep, *[F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


def seed64(text: Column) -> Column:
    """The leading 64 bits of the text's SHA-256 as DECIMAL(20,0); a BIGINT would overflow."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def seed31(text: Column) -> Column:
    """The leading 32 bits without the sign, as BIGINT."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint"))


def bucket_of(key: Like, buckets: int = 100) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("bigint") % buckets


def split_for(key: Like, train: int = 80, val: int = 10) -> Column:
    """train, val or test as a pure function of the key."""
    b = bucket_of(key)
    return F.when(b < train, "train").when(b < train + val, "val").otherwise("test")


def cyclic_choice(values: list[str], offset: Column, ordinal: Column) -> Column:
    """values[(offset + ordinal - 1) mod n]: every value in turn from a stable start."""
    at = (offset + ordinal - 1) % len(values)
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)


def hashed_pick(values: Column, seed: Column) -> Column:
    """One element of an array, chosen by a seed; null for an empty array."""
    return F.when(F.size(values) > 0, F.element_at(values, (seed % F.size(values)).cast("int") + 1))


def _ordered(c: Column, kind: T.DataType) -> Column:
    """A value with the fields of its structs in the order of their names, at every depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*[_ordered(c[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _ordered(x, kind.elementType))
    return c


def canonical_json(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """The columns as compact JSON with sorted keys at every depth; nulls stay as null, other characters than ASCII as they are."""
    whole = F.struct(*[_ordered(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(columns)])
    return F.to_json(whole, {"ignoreNullFields": "false"})


def canonical_digest(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """SHA-256 of canonical_json: equal for equal content, whatever the order in which fields are stored."""
    return F.sha2(canonical_json(df, columns), 256)
