"""Rows with an earlier similar one: an exact prefix join on packed shards of shingles."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.functions import text
from rillstone.session import materialize

#: Shingles that a pair must share in its prefixes, which are longer by as many less one. Pairs held at once.
SHARED, PAIR_BLOCK = 8, 1 << 21
SEGMENT = 1 << 12
Batches = Iterator[pa.RecordBatch]


def earlier_similar(df: DataFrame, key: str, order: str, request: str, threshold: float = 0.48, n: int = 5) -> DataFrame:
    """(key, earlier): rows whose request opens with the same n words as an earlier row's, or whose
    n-gram Jaccard with it is at least the threshold; each with its earliest such row.

    Equal requests are one class, of which the earliest row alone is compared. The order is by the column, ties
    by key; of several rows of a key one with a request is kept. Nothing but packed bytes of the n-grams that
    can decide is shuffled:

    * A table of counts by hashed n-gram, of a fixed number of bytes a request, orders all n-grams from rare to common.
      It only orders: any order gives the same result. Those of count 1 meet nobody; only their number counts.
    * A pair that reaches the threshold shares at least c of its n-grams, so the first SHARED of them stand within
      size - c + SHARED of either side's order. Only these are sent, and only pairs that share so many are compared.
    * Those pairs' whole sets are cut again from the requests, and compared exactly.
    """
    spark = df.sparkSession

    def parts(t):
        joined = F.array_join(t, " ")
        return F.struct(F.size(t).alias("words"), F.unhex(F.md5(joined.cast("binary"))).alias("d"), F.array_join(F.slice(t, 1, n), " ").alias("opening"))

    cut = df.where(F.col(request).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), text.let(text.ascii_tokens(request), parts).alias("p"))
    kept = cut.groupBy("k").agg(F.min(F.struct("o", "p")).alias("m")).select("k", "m.o", "m.p.*").where(F.col("words") >= n)
    rows = materialize(kept.select("k", "o", "d", "opening"), "requests")
    classes = materialize(rows.groupBy("d").agg(F.min(F.struct("o", "k")).alias("f")).select("d", F.hash("d").alias("h"), "f"), "classes")
    count = classes.count()
    hashed = lambda t: F.struct(F.unhex(F.md5(F.array_join(t, " ").cast("binary"))).alias("d"), F.transform(t, lambda w: F.xxhash64(w)).alias("w"))
    words = df.where(F.col(request).isNotNull()).select(text.let(text.ascii_tokens(request), hashed).alias("p")).select("p.d", F.hash("p.d").alias("h"), "p.w")
    twice = classes.groupBy(F.col("h").alias("a")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a", F.col("a").alias("b"))
    near = materialize(_candidates(words, count, threshold, n).unionAll(twice), "near")
    involved = near.select(F.explode(F.array("a", "b")).alias("h")).distinct().toArrow().column(0).to_numpy()
    asked = spark.sparkContext.broadcast(np.sort(involved))

    def whole(batches: Batches) -> Batches:
        for batch in batches:
            h = batch.column(1).to_numpy()
            batch = batch.filter(pa.array(np.isin(h, asked.value)))
            if len(batch):
                doc, g = _shingles(batch.column(2), n)
                order = np.lexsort((g, doc))
                doc, g = doc[order], g[order]
                new = _changes(doc, g)
                doc, g = doc[new], g[new]
                offsets = pa.array(np.searchsorted(doc, np.arange(len(batch) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(g.view(np.int64)))], ["d", "s"])

    sets = words.mapInArrow(whole, "d binary, s array<long>").groupBy("d").agg(F.first("s").alias("s"))
    one, other = (classes.select(F.col("h").alias(c), F.struct("f", "d").alias(f"c{c}")) for c in "ab")
    pairs = near.join(one, "a").join(other, "b").where("ca.d <> cb.d").select(F.greatest("ca", "cb").alias("x"), F.least("ca", "cb").alias("y"))
    scored = pairs.join(sets.select(F.col("d").alias("xd"), F.col("s").alias("xs")), F.col("x.d") == F.col("xd")).join(sets.select(F.col("d").alias("yd"), F.col("s").alias("ys")), F.col("y.d") == F.col("yd"))
    close = scored.where(text.jaccard(F.col("xs"), F.col("ys")) >= threshold).groupBy("xd").agg(F.min("y.f").alias("e")).join(rows, F.col("xd") == F.col("d")).select("k", "e")
    first = rows.groupBy("opening").agg(F.min(F.struct("o", "k")).alias("e"))
    same = rows.join(first, "opening").where(F.struct("o", "k") > F.col("e")).select("k", "e")
    return close.unionAll(same).groupBy("k").agg(F.min("e").alias("e")).select(F.col("k").alias(key), F.col("e.k").alias("earlier"))


def _shingles(words: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash of its n words) for every n-gram of hashed words, in place."""
    offsets = words.offsets.to_numpy()
    w = words.flatten().to_numpy().view(np.uint64)
    ends = np.repeat(offsets[1:] - offsets[0], np.diff(offsets))
    doc = np.repeat(np.arange(len(words)), np.diff(offsets))
    if len(w) < n:
        return doc[:0], w[:0]
    m, g = len(w) - n + 1, np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        g = (g ^ w[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    whole = np.arange(m) + n <= ends[:m]
    return doc[:m][whole], g[whole]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _needed(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """How many elements two sets of these sizes together must share."""
    return np.maximum(np.ceil(threshold / (1 + threshold) * sizes - 1e-6), 1).astype(np.int32)


def _by_shard(df: DataFrame, work: Callable[[Batches], Batches], schema: str) -> DataFrame:
    return df.repartition("shard").sortWithinPartitions("shard").mapInArrow(work, schema)


def _groups(batches: Batches) -> Iterator[tuple[int, list[bytes]]]:
    """Each shard with its payloads; the batches come in the order of shards."""
    now, held = None, []
    for batch in batches:
        for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if shard != now and held:
                yield now, held
                held = []
            now = shard
            held.append(payload)
    if held:
        yield now, held


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers, each in as few bytes as its largest needs."""
    kinds = [np.min_scalar_type(int(c.max(initial=0))) for c in columns]
    head = np.array([[len(c), k.itemsize] for c, k in zip(columns, kinds)], "<u4")
    return np.uint8(len(columns)).tobytes() + head.tobytes() + b"".join(c.astype(k).tobytes() for c, k in zip(columns, kinds))


def _unpacked(payload: bytes) -> list[np.ndarray]:
    at, out = 1 + 8 * payload[0], []
    for size, width in np.frombuffer(payload, "<u4", 2 * payload[0], 1).reshape(-1, 2).tolist():
        out.append(np.frombuffer(payload, f"<u{width}", size, at))
        at += size * width
    return out


def _dealt(shard: np.ndarray, pack: Callable[[np.ndarray], bytes]) -> pa.RecordBatch:
    order = np.argsort(shard, kind="stable")
    starts = np.flatnonzero(_changes(shard[order]))
    cuts = np.split(order, starts[1:]) if len(order) else []
    return pa.RecordBatch.from_arrays([pa.array([int(shard[c[0]]) for c in cuts], pa.int32()), pa.array([pack(c) for c in cuts], pa.binary())], ["shard", "payload"])


def _order_table(words: DataFrame, width: int, n: int) -> np.ndarray:
    """For each of width hashed places, 0 where one n-gram stands there, else 10 times the logarithm of their number."""

    def counted(batches: Batches) -> Batches:
        counts = np.zeros(width, np.uint32)
        for batch in batches:
            _, g = _shingles(batch.column(2), n)
            np.add.at(counts, (g & np.uint64(width - 1)).astype(np.int64), np.uint32(1))
        for i in range(0, width, SEGMENT):
            part = counts[i : i + SEGMENT]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SEGMENT], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["shard", "payload"])

    def summed(batches: Batches) -> Batches:
        for shard, payloads in _groups(batches):
            total = np.zeros(SEGMENT, np.float64)
            for p in payloads:
                part = np.frombuffer(zlib.decompress(p), np.uint32)
                total[: len(part)] += part
            code = np.minimum(np.ceil(10 * np.log(np.maximum(total, 1))), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([code.tobytes()], pa.binary())], ["shard", "payload"])

    table = np.zeros(max(width, SEGMENT), np.uint8)
    # A fixed number of bytes a request, 16 MB at most.
    for r in _by_shard(words.mapInArrow(counted, "shard int, payload binary"), summed, "shard int, payload binary").toLocalIterator():
        table[r.shard * SEGMENT : (r.shard + 1) * SEGMENT] = np.frombuffer(r.payload, np.uint8)
    return table


def _candidates(words: DataFrame, count: int, threshold: float, n: int) -> DataFrame:
    """(a, b): the numbers of classes that may reach the threshold, but for pairs of classes of one number."""
    spark = words.sparkSession
    width = 1 << int(np.clip(np.ceil(np.log2(32 * max(count, 1))), 12, 24))
    shards = int(np.clip(count // 2000, 12, 8192))
    table = spark.sparkContext.broadcast(_order_table(words, width, n))

    def prefixes(batches: Batches) -> Batches:
        code_of = table.value
        for batch in batches:
            doc, g = _shingles(batch.column(2), n)
            code = code_of[(g & np.uint64(width - 1)).astype(np.int64)]
            place = (code.astype(np.uint64) << np.uint64(56)) | (g >> np.uint64(8))
            order = np.lexsort((place, doc))
            doc, place = doc[order], place[order]
            new = _changes(doc, place)
            doc, place = doc[new], place[new]
            bounds = np.searchsorted(doc, np.arange(len(batch) + 1))
            m, at = np.diff(bounds)[doc], np.arange(len(doc)) - bounds[doc]
            sent = (place >> np.uint64(56) > 0) & (at <= m - np.ceil(threshold * m - 1e-6) + SHARED - 1)
            g, m, at = (place[sent] & np.uint64(0xFFFFFFFF)).astype(np.uint32), m[sent], at[sent]
            h = batch.column(1).to_numpy().view(np.uint32)[doc[sent]]
            yield _dealt(((place[sent] >> np.uint64(32)) % np.uint64(shards)).astype(np.int32), lambda c: _packed(g[c], h[c], m[c], at[c]))  # noqa: B023

    def sent_on(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.sort(np.concatenate(found))
        a, b = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)

        def pack(c: np.ndarray) -> bytes:
            starts = np.flatnonzero(_changes(a[c]))
            return _packed(a[c][starts], np.diff(np.r_[starts, len(c)]), b[c])

        return _dealt((a % np.uint32(shards)).astype(np.int32), pack)

    def meet(batches: Batches) -> Batches:
        found, held = [], 0
        for _, payloads in _groups(batches):
            g, h, m, at = (np.concatenate(x) for x in zip(*map(_unpacked, payloads)))
            m, at = m.astype(np.int32), at.astype(np.int32)
            # c at most: the other side's share that leaves this place in the prefix. A place that only smaller sets
            # reach stands last in its group, since two of them never make a pair.
            most = m - at + SHARED - 1
            beyond = most < _needed(2 * m, threshold)
            order = np.lexsort((at, m, h, beyond, g))
            g, h, m, at, most, beyond = (x[order] for x in (g, h, m, at, most, beyond))
            new = _changes(g, h, m, at)
            g, h, m, most, beyond = (x[new] for x in (g, h, m, most, beyond))
            sizes = np.where(beyond, 0, np.searchsorted(g, g, "right") - np.arange(len(g)) - 1)
            needed = _needed(np.arange(2 * int(m.max()) + 1), threshold)
            before, i = np.cumsum(sizes), 0
            while i < len(g):
                j = max(i + 1, int(np.searchsorted(before, (before[i - 1] if i else 0) + PAIR_BLOCK, "right")))
                one, other = np.repeat(np.arange(i, j), sizes[i:j]), _ranges(np.arange(i, j) + 1, sizes[i:j])
                i = j
                c = needed[m[one] + m[other]]
                ok = (c <= most[one]) & (c <= most[other])
                one, other, c = one[ok], other[ok], c[ok]
                ok = np.minimum(m[one], m[other]) >= threshold * np.maximum(m[one], m[other]) - 1e-6
                # Pairs that need share no more than a few count as often as it takes.
                often = np.maximum(SHARED - c[ok], 0) + 1
                a, b = h[one[ok]].astype(np.uint64), h[other[ok]].astype(np.uint64)
                found.append(np.repeat(np.minimum(a, b) << np.uint64(32) | np.maximum(a, b), often))
                held += len(found[-1])
                if held >= PAIR_BLOCK:
                    yield sent_on(found)
                    found, held = [], 0
        if held:
            yield sent_on(found)

    def counted(batches: Batches) -> Batches:
        for _, payloads in _groups(batches):
            both = []
            for p in payloads:
                a, times, b = _unpacked(p)
                both.append(np.repeat(a, times).astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
            pairs, times = np.unique(np.concatenate(both), return_counts=True)
            pairs = pairs[times >= SHARED]
            yield pa.RecordBatch.from_arrays([pa.array((pairs >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))], ["a", "b"])

    shape = "shard int, payload binary"
    return _by_shard(_by_shard(words.mapInArrow(prefixes, shape), meet, shape), counted, "a int, b int")
