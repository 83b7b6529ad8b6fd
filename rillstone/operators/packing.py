"""Balanced partitions and packs of variable-length samples, bin by bin inside Arrow groups."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_fit(lengths: list[int], limit: int) -> list[int]:
    """The bin of each length: the first with room, a new one if none has. A length above the limit stands alone."""
    room: list[int] = []
    out = []
    for n in lengths:
        b = next((i for i, used in enumerate(room) if used + n <= limit), len(room))
        if b == len(room):
            room.append(0)
        room[b] += n
        out.append(b)
    return out


def differencing(lengths: list[int], k: int, equal_size: bool = False) -> list[int]:
    """The part of each length by largest differencing: partial solutions of widest spread are merged,
    largest sums against smallest, until one is left. equal_size: parts of equally many items."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    if equal_size and len(order) % k:
        raise ValueError(f"{len(order)} items do not divide into {k} equal parts")
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []

    def push(parts: list[tuple[int, list[int]]], tie: int) -> None:
        parts.sort(key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], tie, parts))

    step = k if equal_size else 1
    for tie, at in enumerate(range(0, len(order), step)):
        items = order[at : at + step]
        push([(lengths[i], [i]) for i in items] + [(0, []) for _ in range(k - len(items))], tie)
    tie = len(order)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        push([(s + t, x + y) for (s, x), (t, y) in zip(a, reversed(b))], tie := tie + 1)
    out = [0] * len(lengths)
    for part, (_, items) in enumerate(heap[0][2] if heap else []):
        for i in items:
            out[i] = part
    return out


def greedy(lengths: list[int], k: int, equal_size: bool = False) -> list[int]:
    """Each length in turn to the part with the smallest sum (and, with equal_size, the fewest items)."""
    bias = sum(lengths) + 1 if equal_size else 0
    heap = [(0, i) for i in range(k)]
    out = []
    for n in lengths:
        total, part = heapq.heappop(heap)
        heapq.heappush(heap, (total + n + bias, part))
        out.append(part)
    return out


def packed(df: DataFrame, batch: str, key: str, length: str, method: str, size: int) -> DataFrame:
    """Assign each row a bin within its batch: (batch, key, length, bin).

    method: first_fit (size = token limit), karmarkar_karp or greedy (size = number of parts).
    Batches are training-step sized, so each fits a task; the number of batches grows with the
    data. Order within a batch is by key. Null lengths count as 0.
    """
    rule = {"first_fit": lambda x: first_fit(x, size), "karmarkar_karp": lambda x: differencing(x, size), "greedy": lambda x: greedy(x, size)}[method]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable")
        rows["bin"] = rule([int(n) for n in rows[length]])
        return rows

    plain = df.select(batch, key, F.coalesce(F.col(length), F.lit(0)).cast("long").alias(length))
    schema = ", ".join(f"`{c}` {t}" for c, t in plain.dtypes) + ", bin int"
    return plain.groupBy(batch).applyInPandas(run, schema)


def chunked(df: DataFrame, batch: str, key: str, length: str, limit: int) -> DataFrame:
    """Consecutive chunks: a new one starts where the running sum would pass the limit."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable")
        chunk, used, out = 0, 0, []
        for n in rows[length]:
            if used and used + n > limit:
                chunk, used = chunk + 1, 0
            used += int(n)
            out.append(chunk)
        rows["chunk"] = out
        return rows

    plain = df.select(batch, key, F.coalesce(F.col(length), F.lit(0)).cast("long").alias(length))
    schema = ", ".join(f"`{c}` {t}" for c, t in plain.dtypes) + ", chunk int"
    return plain.groupBy(batch).applyInPandas(run, schema)


def joined_packs(df: DataFrame, pack: list[str], order: str, tokens: str) -> DataFrame:
    """One row per pack: tokens in order, position ids and cumulative sequence lengths."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(tokens), F.array().cast(dict(df.dtypes)[tokens])).alias("t"))))
    p = df.groupBy(*pack).agg(rows.alias("rows"))
    sizes = F.transform("rows", lambda r: F.size(r["t"]))
    cu = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    positions = F.flatten(F.transform("rows", lambda r: F.when(F.size(r["t"]) > 0, F.sequence(F.lit(0), F.size(r["t"]) - 1)).otherwise(F.array().cast("array<int>"))))
    return p.select(*pack, F.flatten(F.transform("rows", lambda r: r["t"])).alias("tokens"), positions.alias("position_ids"), cu.alias("cu_seqlens"))


def split_packs(df: DataFrame, pack: list[str], values: str = "tokens", cu: str = "cu_seqlens") -> DataFrame:
    """The inverse: one row per sequence (pack, seq, values)."""
    spans = F.transform(F.sequence(F.lit(1), F.size(cu) - 1), lambda i: F.struct((i - 1).alias("seq"), F.element_at(cu, i).alias("a"), F.element_at(cu, i + 1).alias("b")))
    rows = df.where(F.size(cu) > 1).select(*pack, values, F.explode(spans).alias("s"))
    return rows.select(*pack, "s.seq", F.slice(values, (F.col("s.a") + 1).cast("int"), (F.col("s.b") - F.col("s.a")).cast("int")).alias(values))
