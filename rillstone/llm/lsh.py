"""Near-duplicate texts: banded signatures, star edges, groups, then exact Jaccard inside groups.

The stages, each of them distributed:

1. every text becomes its set of word shingles and the set's 64-bit name; copies share
   the name, so all later work is per distinct set ("class");
2. signatures (minwise hashing with independent permutations, or one-permutation hashing
   with optimal densification) are cut into bands. A batch packs its (band key, class)
   pairs into one blob per bucket shard and first collapses equal keys, so a hot bucket
   arrives as at most one entry per batch;
3. each bucket links its members to its least class: a star, not all pairs;
4. links whose byte sketches agree too little are dropped, and the rest are closed to
   groups by distributed connected components;
5. inside a small group every two classes are compared; inside a larger one a prefix join over the
   group's rarest shingles first: two sets with Jaccard t share a shingle among the first
   n - ceil(t n) + 1 of each, so only those meet, keyed by (group, shingle), only if what the
   shared prefix leaves possible reaches t, and the exact similarity decides.

Stage 5 finds every pair of a group; a pair is lost only if no chain of buckets joins its two
classes, of probability below (1 - t**rows)**bands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.llm.shingling import mix, set_ids, word_shingles
from rillstone.operators.graph import connected_components
from rillstone.session import materialize, spread

PROBES = 64
FULL32 = np.uint32(0xFFFFFFFF)
CHUNK_ROWS, CHUNK_CHARS = 2048, 1 << 20
#: Bytes of a bucket entry, and how many entries a map task links and packs together.
ENTRY_BYTES, HELD_ENTRIES = 17, 1 << 20
#: Groups of so many classes are compared two by two; a class then meets at most as many others.
SMALL_GROUP = 24


@dataclass(frozen=True)
class Settings:
    """threshold: least Jaccard; words: a shingle's length; signature: "minhash" or "oph";
    bands x rows: the signature's shape; cross: only pairs between side 1 and side 2;
    sketch: bytes per class for the cheap test; slack: how far below the threshold a sketch may lie."""

    threshold: float = 0.8
    words: int = 5
    signature: str = "oph"
    bands: int = 128
    rows: int = 5
    cross: bool = False
    sketch: int = 48
    slack: float = 0.23
    seed: int = 20240611


def salt_of(fields: list[str]) -> np.ndarray:
    """A 64-bit number per field name, so that equal texts of different fields never meet."""
    out = np.zeros(len(fields), np.uint64)
    cache: dict[str, np.uint64] = {}
    for i, f in enumerate(fields):
        if f not in cache:
            x = np.uint64(0)
            for b in (f or "").encode():
                x = mix(np.array([x + np.uint64(b + 1)], np.uint64))[0]
            cache[f] = x
        out[i] = cache[f]
    return out


def minhash(shingles: np.ndarray, offsets: np.ndarray, count: int, seed: int) -> np.ndarray:
    """count minwise values per non-empty set, from as many affine permutations of 32-bit hashes."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, count, dtype=np.uint32)
    h = (mix(shingles ^ np.uint64(seed)) >> np.uint64(32)).astype(np.uint32)
    begin = offsets[:-1]
    out = np.empty((len(begin), count), np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(h * a[k] + b[k], begin)
    return out


_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _probe_tables(bins: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Per turn and bin: the bin that is asked when it is empty; and a last full order of all bins."""
    if (bins, seed) not in _tables:
        x = np.arange(bins * PROBES, dtype=np.uint64).reshape(bins, PROBES)
        probe = (((mix(x + np.uint64(seed)) >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int32).T.copy()
        y = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins)
        _tables[bins, seed] = probe, (mix(y ^ np.uint64(seed * 31 + 7)) >> np.uint64(32)).astype(np.uint32)
    return _tables[bins, seed]


def one_permutation(shingles: np.ndarray, offsets: np.ndarray, bins: int, seed: int) -> np.ndarray:
    """One hash per shingle: its high half picks a bin, its low half competes there; empty bins
    borrow from the first non-empty bin of a sequence that depends on the bin alone, so two sets
    agree in a borrowed bin with their Jaccard similarity (optimal densification)."""
    n = len(offsets) - 1
    h = mix(shingles ^ np.uint64(seed))
    bin_of = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    low = np.minimum((h & np.uint64(0xFFFFFFFF)).astype(np.uint32), FULL32 - np.uint32(1))
    who = np.repeat(np.arange(n), np.diff(offsets))
    flat = np.full(n * bins, FULL32, np.uint32)
    np.minimum.at(flat, who * bins + bin_of.astype(np.int64), low)
    sig = flat.reshape(n, bins)
    filled = sig != FULL32
    probe, order = _probe_tables(bins, seed)
    # Flat places of the empty bins, their texts' first places, and their numbers within the text.
    has, to = filled.ravel(), np.flatnonzero(flat == FULL32).astype(np.int32 if n * bins < 2**31 else np.int64)
    base = to // bins * bins
    j = to - base
    for r in range(PROBES):
        if not len(to):
            break
        ask = base + probe[r].take(j)
        hit = has.take(ask)
        flat[to[hit]] = flat.take(ask[hit])
        miss = np.flatnonzero(~hit)
        to, base, j = to.take(miss), base.take(miss), j.take(miss)
    for one in np.unique(base):
        own = np.flatnonzero(filled[one // bins])
        need = j[base == one]
        sig[one // bins, need] = sig[one // bins, own[np.argmin(order[np.ix_(need, own)], axis=1)]]
    return sig


def signature_of(s: Settings, shingles: np.ndarray, offsets: np.ndarray, count: int, seed: int) -> np.ndarray:
    return (minhash if s.signature == "minhash" else one_permutation)(shingles, offsets, count, seed)


def band_keys(sig: np.ndarray, bands: int, rows: int, salt: np.ndarray) -> np.ndarray:
    """A 64-bit key for each text (row) and band (column)."""
    key = np.repeat(salt[:, None], bands, 1) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    cut = sig.reshape(len(sig), bands, rows)
    for r in range(rows):
        key = mix(key.ravel() ^ cut[:, :, r].astype(np.uint64).ravel()).reshape(key.shape) + np.uint64(r)
    return mix(key.ravel()).reshape(key.shape)


def _chunks(batch: pa.RecordBatch) -> Iterator[dict]:
    """Pieces of a batch of (field, id, side, parts) with bounded text, as shingle sets."""

    def piece(lo: int, hi: int) -> dict:
        parts, owner = [], []
        for i in range(lo, hi):
            for p in texts[i] or ():
                if p:
                    parts.append(p)
                    owner.append(i - lo)
        return {"lo": lo, "hi": hi, "parts": parts, "owner": np.array(owner, np.int64)}

    texts = batch.column("parts").to_pylist()
    lo = chars = 0
    for i, t in enumerate(texts):
        own = sum(len(p) for p in t or () if p)
        if i > lo and (i - lo >= CHUNK_ROWS or chars + own > CHUNK_CHARS):
            yield piece(lo, i)
            lo, chars = i, 0
        chars += own
    if texts:
        yield piece(lo, len(texts))


def _sets(batch: pa.RecordBatch, s: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece: its rows, shingles, offsets, field salts and class names."""
    fields = batch.column("field").to_pylist()
    for c in _chunks(batch):
        n = c["hi"] - c["lo"]
        shingles, offsets = word_shingles(c["parts"], c["owner"], n, s.words)
        salt = salt_of(fields[c["lo"] : c["hi"]])
        yield c["lo"], c["hi"], shingles, offsets, salt, set_ids(shingles, offsets, salt)


def _pick(shingles: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the chosen sets alone."""
    size = np.diff(offsets)[which]
    to = np.concatenate(([0], np.cumsum(size)))
    index = np.arange(to[-1]) + np.repeat(offsets[:-1][which] - to[:-1], size)
    return shingles[index], to


def members_of(units: DataFrame, s: Settings) -> DataFrame:
    """Each text that has a shingle: (field, id, side, cls, size, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, shingles, offsets, _, cls in _sets(batch, s):
                has = np.flatnonzero(np.diff(offsets) > 0)
                if not len(has):
                    continue
                some, to = _pick(shingles, offsets, has)
                sketch = one_permutation(some, to, s.sketch, s.seed + 1).astype(np.uint8)
                rows = batch.slice(lo, hi - lo).take(pa.array(has))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("field"), rows.column("id"), rows.column("side"), pa.array(cls[has]), pa.array(np.diff(to).astype(np.int32)), pa.array([x.tobytes() for x in sketch], pa.binary())],
                    ["field", "id", "side", "cls", "size", "sketch"],
                )

    return units.select("field", "id", F.col("side").cast("int"), "parts").mapInArrow(run, "field string, id string, side int, cls long, size int, sketch binary")


def finer_bytes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each text and band four more signature bytes, those of the next bands, as one number."""
    low = sig.reshape(len(sig), bands, rows)[:, :, 0] & np.uint32(0xFF)
    out = np.zeros(low.shape, np.uint32)
    for k in range(1, 5):
        out = (out << np.uint32(8)) | np.roll(low, -k, axis=1)
    return out


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys that stand once and those that stand more often are."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    often = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(key) else np.zeros(0, bool)
    return order[~often], order[often]


def _stars(key: np.ndarray, fine: np.ndarray, cls: np.ndarray, side: np.ndarray, levels: tuple[int, ...], cross: bool) -> tuple[np.ndarray, ...]:
    """Links of each bucket's classes to its least one, and one entry per key and fine number.

    A level of n links within the bucket's parts that agree in n finer bytes too: as buckets fill
    with unlike texts, whose star centre helps nobody, alike ones still meet in a finer part.
    Returns (a, b, first place of each entry in the sorted input, order, least, sides).
    """
    if not len(key):
        none = np.zeros(0, np.int64)
        return none, none, none, none, cls, side
    order = np.lexsort((cls, fine, key))
    key, fine, cls, side = key[order], fine[order], cls[order], side[order]
    found = []
    for level in levels:
        part = fine >> np.uint32(32 - 8 * level) if level else np.zeros(len(fine), np.uint32)
        begin = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
        size = np.diff(np.concatenate((begin, [len(key)])))
        least, sides = np.minimum.reduceat(cls, begin), np.bitwise_or.reduceat(side, begin)
        centre = np.repeat(least, size)
        link = centre != cls
        if cross:
            link &= np.repeat(sides, size) == 3
        found.append(np.stack((centre[link], cls[link]), 1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1], begin, order, least, sides


def candidate_links(units: DataFrame, s: Settings, texts: int) -> DataFrame:
    """Star-shaped candidate links between classes that share a bucket: (a, b), a < b, distinct.

    With cross, a bucket counts only if both sides are in it. texts: about how many there are; where
    their entries would exceed the session's advisory size in its partitions, there are more. Shards
    go to the partitions in turn, each to as many, not by hash.
    """
    spark = units.sparkSession
    wanted = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts * s.bands * ENTRY_BYTES // wanted)
    # Several shards for each partition even out their sizes; very many would make the blobs tiny.
    shards = min(16 * partitions, max(4 * partitions, 1024))
    columns = ("keys", "fine", "a", "b")

    def packed_entries(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """One blob per shard that the held entries reach, after equal keys have been linked and collapsed."""
        key, fine, cls, side = (np.concatenate(x) for x in zip(*held))
        alone, many = _repeated(key)
        a, b, begin, order, least, sides = _stars(key[many], fine[many], cls[many], side[many], (4,), False)
        first = many[order[begin]]
        key, fine = np.concatenate((key[alone], key[first])), np.concatenate((fine[alone], fine[first]))
        cls, side = np.concatenate((cls[alone], least)), np.concatenate((side[alone], sides))
        shard = (key % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        shard, short = shard[order], (key >> np.uint64(32)).astype(np.uint32)[order]
        fine, cls, side = fine[order], cls[order], side[order]
        cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))).tolist()
        rows = [(int(shard[lo]), short[lo:hi].tobytes(), fine[lo:hi].tobytes(), cls[lo:hi].tobytes(), side[lo:hi].tobytes() if s.cross else b"") for lo, hi in zip(cut, cut[1:])]
        if len(a):
            rows.append((int(a[0] % shards), b"", b"", a.tobytes(), b.tobytes()))
        number, *blobs = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], ["shard", *columns])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for lo, hi, shingles, offsets, salt, cls in _sets(batch, s):
                has = np.flatnonzero(np.diff(offsets) > 0)
                if not len(has):
                    continue
                side = np.array([x or 0 for x in batch.column("side").slice(lo, hi - lo).to_pylist()], np.uint8)[has]
                names, first, which = np.unique(cls[has], return_index=True, return_inverse=True)
                sides = np.zeros(len(names), np.uint8)
                np.bitwise_or.at(sides, which, side)
                some, to = _pick(shingles, offsets, has[first])
                sig = signature_of(s, some, to, s.bands * s.rows, s.seed)
                held.append((band_keys(sig, s.bands, s.rows, salt[has[first]]).ravel(), finer_bytes(sig, s.bands, s.rows).ravel(), np.repeat(names, s.bands), np.repeat(sides, s.bands)))
                size += len(names) * s.bands
                if size >= HELD_ENTRIES:
                    yield packed_entries(held)
                    held, size = [], 0
        if held:
            yield packed_entries(held)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            key = np.frombuffer(b"".join(held["keys"]), np.uint32)
            at = _repeated(key)[1]
            cls = np.frombuffer(b"".join(held["a"]), np.int64)[at]
            side = np.frombuffer(b"".join(held["b"]), np.uint8)[at] if s.cross else np.zeros(len(at), np.uint8)
            fine = np.frombuffer(b"".join(held["fine"]), np.uint32)[at]
            a, b, *_ = _stars(key[at], fine, cls, side, (0, 1, 2, 3, 4), s.cross)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: dict[str, list[bytes]] = {"keys": [], "fine": [], "a": [], "b": []}
        now = None
        for batch in batches:
            for shard, keys, fine, a, b in zip(*(batch.column(c).to_pylist() for c in ("shard", "keys", "fine", "a", "b"))):
                if shard != now and held["keys"]:
                    yield done()
                    held = {"keys": [], "fine": [], "a": [], "b": []}
                now = shard
                if keys:
                    for c, x in (("keys", keys), ("fine", fine), ("a", a), ("b", b)):
                        held[c].append(x)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64))], ["a", "b"])
        if held["keys"]:
            yield done()

    packed = units.select("field", "id", F.col("side").cast("int"), "parts").mapInArrow(pack, "shard int, keys binary, fine binary, a binary, b binary")
    return packed.repartitionById(partitions, F.col("shard") % partitions).sortWithinPartitions("shard").mapInArrow(link, "a long, b long").distinct()


def _agreement(bytes_: int):
    @F.pandas_udf("double")
    def agree(x, y):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype="float64")
        left = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), bytes_)
        right = np.frombuffer(b"".join(y), np.uint8).reshape(len(y), bytes_)
        return pd.Series((left == right).mean(1))

    return agree


def group_links(links: DataFrame, members: DataFrame, s: Settings) -> DataFrame:
    """The links whose sketches agree in at least threshold - slack of their bytes."""
    ends = links.select(F.col("a").alias("cls")).unionAll(links.select("b")).distinct()
    sketches = members.join(ends, "cls", "left_semi").groupBy("cls").agg(F.min("sketch").alias("sketch"))
    both = links.join(sketches.select(F.col("cls").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("cls").alias("b"), F.col("sketch").alias("y")), "b")
    return both.select("a", "b", _agreement(s.sketch)("x", "y").alias("agree")).where(F.col("agree") >= s.threshold - s.slack).select("a", "b")


def class_sets(units: DataFrame, members: DataFrame, groups: DataFrame, s: Settings) -> DataFrame:
    """The shingle set of each class in a group: (comp, cls, sides, size, shingles ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, shingles, offsets, _, cls in _sets(batch, s):
                rows = batch.slice(lo, hi - lo)
                keep = np.flatnonzero(cls == np.array(rows.column("cls").to_pylist(), np.int64))
                signed = shingles.view(np.int64)
                sets = [np.sort(signed[offsets[i] : offsets[i + 1]]) for i in keep]
                got = rows.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([got.column("comp"), got.column("cls"), got.column("sides"), pa.array(sets, pa.list_(pa.int64()))], ["comp", "cls", "sides", "shingles"])

    chosen = members.join(groups, members.cls == groups.node).groupBy("cls").agg(F.min(F.struct("id", "field")).alias("one"), F.bit_or("side").alias("sides"), F.min("component").alias("comp"))
    chosen = chosen.select("cls", "sides", "comp", F.col("one.id").alias("id"), F.col("one.field").alias("field"))
    texts = units.select("field", "id", "parts").join(chosen, ["field", "id"])
    sets = texts.mapInArrow(run, "comp long, cls long, sides int, shingles array<long>").dropDuplicates(["cls"])
    return sets.withColumn("size", F.size("shingles"))


def _matching(a: str, b: str, s: Settings) -> Column:
    """Two classes of one group, each pair once, of sizes that allow the threshold, on both sides with cross."""
    c = lambda side, name: F.col(f"{side}.{name}")
    rule = (c(a, "comp") == c(b, "comp")) & (c(a, "cls") < c(b, "cls")) & (F.least(c(a, "size"), c(b, "size")) >= s.threshold * F.greatest(c(a, "size"), c(b, "size")))
    return rule & (c(a, "sides").bitwiseOR(c(b, "sides")) == 3) if s.cross else rule


def prefix_candidates(sets: DataFrame, s: Settings) -> DataFrame:
    """(a, b): classes of one group that share a shingle of their prefixes, the group's rarest shingles first, and
    whose shared prefix leaves enough for the threshold. No alike pair is missing.

    After the last shared shingle of both prefixes only what follows it on both sides can still be shared.
    """
    t = s.threshold
    each = sets.select("comp", "cls", "sides", "size", F.explode("shingles").alias("s"))
    often = each.groupBy("comp", "s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Shingles that stand once come first and meet nobody: only their number counts.
    shared = each.join(often, ["comp", "s"]).groupBy("comp", "cls", "sides", "size").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("ds"))
    alone = F.col("size") - F.size("ds")
    first = F.slice("ds", F.lit(1), F.greatest(F.col("size") - F.ceil(F.col("size") * t) + 1 - alone, F.lit(0)).cast("int"))
    prefix = shared.select("comp", "cls", "sides", "size", alone.alias("alone"), F.posexplode(first).alias("at", "d")).select("comp", "cls", "sides", "size", (F.col("at") + F.col("alone")).alias("at"), F.col("d.s").alias("s"))
    met = prefix.alias("a").join(prefix.alias("b"), _matching("a", "b", s) & (F.col("a.s") == F.col("b.s")))
    left = lambda x: F.max(F.col(f"{x}.at")).alias(f"{x}_last")
    seen = met.groupBy(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"), F.col("a.size").alias("an"), F.col("b.size").alias("bn")).agg(F.count(F.lit(1)).alias("n"), left("a"), left("b"))
    possible = F.col("n") + F.least(F.col("an") - F.col("a_last"), F.col("bn") - F.col("b_last")) - 1
    return seen.where(possible >= t / (1 + t) * (F.col("an") + F.col("bn")) - 1e-6).select("a", "b")


def exact_pairs(sets: DataFrame, s: Settings) -> DataFrame:
    """Pairs of classes of one group with Jaccard similarity of at least the threshold."""
    sizes = sets.groupBy("comp").agg(F.count(F.lit(1)).alias("classes"))
    sets = sets.join(sizes, "comp")
    small = sets.where(F.col("classes") <= SMALL_GROUP).select("comp", "cls", "sides", "size")
    beside = small.alias("a").join(small.alias("b"), _matching("a", "b", s)).select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"))
    met = beside.unionAll(prefix_candidates(sets.where(F.col("classes") > SMALL_GROUP), s))
    one = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    scored = met.join(one, "a").join(two, "b").select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("jaccard"))
    return scored.where(F.col("jaccard") >= s.threshold)


@dataclass(frozen=True)
class NearDuplicates:
    """members: each text with its class; pairs: classes (a, b) with their similarity; groups: (node, component)."""

    members: DataFrame
    pairs: DataFrame
    groups: DataFrame

    def record_pairs(self, cross: bool = False) -> DataFrame:
        """All alike pairs of different ids: (field, id_1, id_2), the smaller id first, each once."""
        m = self.members.select("field", "id", "side", "cls").distinct()
        links = self.pairs.select(F.col("a"), F.col("b"))
        repeated = m.groupBy("cls").agg(F.count_distinct("id").alias("n"), F.bit_or("side").alias("sides")).where("n > 1" + " and sides = 3" * cross)
        links = links.unionAll(repeated.select(F.col("cls").alias("a"), F.col("cls").alias("b")))
        x = m.select("field", F.col("id").alias("x"), F.col("side").alias("xs"), F.col("cls").alias("a"))
        y = m.select(F.col("id").alias("y"), F.col("side").alias("ys"), F.col("cls").alias("b"))
        both = links.join(x, "a").join(y, "b").where("x != y" + " and xs | ys = 3" * cross)
        return both.select("field", F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2")).distinct()

    def classes(self) -> DataFrame:
        """One row per text: (field, id, cls, group_id, links), links counting other classes alike to its own."""
        ends = self.pairs.select(F.col("a").alias("cls")).unionAll(self.pairs.select("b")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
        found = connected_components(self.pairs, "a", "b").select(F.col("node").alias("cls"), F.col("component").alias("group_id"))
        m = self.members.select("field", "id", "cls").distinct()
        return m.join(ends, "cls", "left").join(found, "cls", "left").select("field", "id", "cls", F.coalesce("group_id", "cls").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicates(units: DataFrame, s: Settings) -> NearDuplicates:
    """Near-duplicates among units (field string, id string, side int, parts array<string>).

    A unit's set unites those of its parts. Null and empty parts add nothing; a unit without
    a shingle, or with null parts, is like nothing. Repeated rows change nothing. An id with
    several texts has the links of each. Other columns are ignored. No units give empty tables.
    """
    units = spread(units.select("field", "id", "side", "parts"))
    members = materialize(members_of(units, s), "members")
    candidates = materialize(candidate_links(units, s, members.count()), "candidates")
    links = materialize(group_links(candidates, members, s), "links")
    groups = materialize(connected_components(links, "a", "b"), "groups")
    sets = materialize(class_sets(units, members, groups, s), "sets")
    return NearDuplicates(members, materialize(exact_pairs(sets, s), "pairs"), groups)


def miss_probability(s: Settings, similarity: float) -> float:
    """Chance that two sets of this similarity share no bucket."""
    return math.pow(1 - similarity**s.rows, s.bands)
