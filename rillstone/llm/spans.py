"""Problem 9: long exact spans shared between records, by super-k-mer partitioning.

A window is a run of `length` code points. Its minimiser is the least hash among its m-mers.
Consecutive windows of a text that share a minimiser travel as one packed string (a
super-k-mer) to the minimiser's partition, where the windows are sorted by hash and equal ones
counted, so each window of the corpus is sorted exactly once. Equal hashes are confirmed on the
characters of every window.

Skew: equal super-k-mers of one map chunk collapse to one entry before the shuffle (their
places travel apart, keyed by the entry). Partitions are sorted by minimiser and read as a
stream; where one minimiser turns out to have more entries than a task should sort, its entries
are cut anew by longer minimisers and go through another round. Equal windows agree in their
minimisers of every length, so each round finds the same pairs, whatever the bound; the last
round's minimiser is the window itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm.shingling import mix, powers
from rillstone.session import materialize, spread

CHUNK = 1 << 20
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
#: A packed super-k-mer: text holds `off` .. of the entry (lid, doc, start), which stands in `docs` documents.
PACKED = "m long, lid long, doc long, start long, off long, docs int, text binary"
#: kind 0: a shared run; 1: a place of a collapsed entry; 2: a super-k-mer for the next round (family is its minimiser).
FOUND = "kind int, family long, lid long, doc long, start long, off long, windows long, text binary"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]
PACKED_NAMES = [c.split()[0] for c in PACKED.split(", ")]


@dataclass(frozen=True)
class SpanSettings:
    """length: least shared run in code points; mer: length of the first round's minimisers; heavy:
    entries of one minimiser beyond which they are cut anew by longer ones (the result is the same)."""

    length: int = 230
    mer: int = 31
    heavy: int = 20_000

    def mers(self) -> list[int]:
        """The rounds' minimiser lengths; each halves what is missing to the window's length."""
        out = [self.mer]
        while out[-1] < self.length:
            out.append((out[-1] + self.length + 1) // 2)
        return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _prefix(c: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash, modulo 2**64."""
    up, _ = powers(len(c) + 1)
    values = mix(c.astype(np.uint64) + np.uint64(0x51))
    values *= up[: len(c)]
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))


def _hashes(sums: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    _, down = powers(len(sums) + 1)
    return mix((sums[start + length] - sums[start]) * down[start])


def _every_hash(sums: np.ndarray, length: int) -> np.ndarray:
    """The hashes of all stretches of one length."""
    _, down = powers(len(sums) + 1)
    return mix((sums[length:] - sums[:-length]) * down[: len(sums) - length])


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def _pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Documents in groups of bounded text: (ids, texts, where each text begins in its document).

    A very long text comes in segments that overlap by length - 1, so that each of its windows
    is in exactly one.
    """
    ids, texts, begins, size = [], [], [], 0
    for i, whole in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        if i is None or whole is None:
            continue
        for at in range(0, len(whole) - length + 1, CHUNK):
            t = whole if len(whole) <= CHUNK else whole[at : at + CHUNK + length - 1]
            if ids and size + len(t) > CHUNK:
                yield ids, texts, begins
                ids, texts, begins, size = [], [], [], 0
            ids.append(i)
            texts.append(t)
            begins.append(at)
            size += len(t)
    if ids:
        yield ids, texts, begins


@dataclass
class Cut:
    """Super-k-mers of joined texts: whose text, place in the joined codes, number of windows, minimiser."""

    text: np.ndarray
    at: np.ndarray
    windows: np.ndarray
    least: np.ndarray


def cut(sums: np.ndarray, size: np.ndarray, length: int, mer: int) -> Cut:
    """The super-k-mers of texts of the given sizes, each of at least `length`, from their joined prefix sums."""
    begin = np.cumsum(size) - size
    least = _sliding_min(_every_hash(sums, mer), length - mer + 1)
    text = np.repeat(np.arange(len(size)), size)[: len(least)]
    valid = np.arange(len(least)) + length <= np.repeat(begin + size, size)[: len(least)]
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    fresh &= valid
    at = np.flatnonzero(fresh)
    windows = np.bincount((np.cumsum(fresh) - 1)[valid], minlength=len(at))
    return Cut(text[at], at, windows, least[at].view(np.int64))


def _collapse(name: np.ndarray, length: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal super-k-mers as one entry: (first of each, entry of each, places, documents)."""
    order = np.lexsort((start, doc, length, name))
    name, length, doc = name[order], length[order], doc[order]
    new = np.concatenate(([True], (name[1:] != name[:-1]) | (length[1:] != length[:-1])))
    entry = np.cumsum(new) - 1
    new_doc = new | np.concatenate(([True], doc[1:] != doc[:-1]))
    which = np.empty(len(order), np.int64)
    which[order] = entry
    return order[new], which, np.bincount(entry), np.bincount(entry, weights=new_doc).astype(np.int64)


def _byte_places(c: np.ndarray) -> np.ndarray:
    """Where each code point begins in UTF-8."""
    width = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
    return np.concatenate(([0], np.cumsum(width)))


def _packed(raw: bytes, byte_at: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.array([raw[a:b] for a, b in zip(byte_at[at].tolist(), byte_at[at + size].tolist())], pa.binary())


def super_kmers(ids: list[int], texts: list[str], begins: list[int], s: SpanSettings) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
    """The collapsed super-k-mers of some texts, packed, and the places of those that stand more than once."""
    joined = "".join(texts)
    c = codes(joined)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    sums = _prefix(c)
    k = cut(sums, size, s.length, s.mer)
    length = k.windows + s.length - 1
    doc, start = np.array(ids, np.int64)[k.text], k.at - begin[k.text] + np.array(begins, np.int64)[k.text]
    name = _hashes(sums, k.at, length)
    first, entry, places, documents = _collapse(name, length, doc, start)
    here = mix(np.array([ids[0], begins[0]], np.int64).view(np.uint64))
    lid = np.where(places > 1, mix(name[first] ^ here[0] ^ (here[1] * SECOND) ^ length[first].astype(np.uint64)), np.uint64(0)).view(np.int64)
    text = _packed(joined.encode("utf-8", "surrogatepass"), _byte_places(c), k.at[first], length[first])
    whole = pa.RecordBatch.from_arrays([*map(pa.array, (k.least[first], lid, doc[first], start[first], np.zeros(len(first), np.int64), documents.astype(np.int32))), text], PACKED_NAMES)
    shared = np.flatnonzero(places[entry] > 1)
    if not len(shared):
        return whole, None
    # A place is a packed row without text, off its entry's way.
    blank = np.zeros(len(shared), np.int64)
    spots = pa.RecordBatch.from_arrays([*map(pa.array, (name[shared].view(np.int64), lid[entry[shared]], doc[shared], start[shared], blank, blank.astype(np.int32))), pa.nulls(len(shared), pa.binary())], PACKED_NAMES)
    return whole, spots


def _codes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined code points of packed texts, and how many each has."""
    text = pa.concat_arrays([text])
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    if not len(raw) or raw.max() < 0x80:
        return raw.astype(np.uint32), np.diff(offsets)
    before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return codes(raw.tobytes().decode("utf-8", "surrogatepass")), np.diff(before[offsets - offsets[0]])


def _found(kind: int, family, lid, doc, start, off, windows, text: pa.Array | None = None) -> pa.RecordBatch:
    n = len(lid)
    columns = [np.full(n, kind, np.int32), family, lid, doc, start, off, windows]
    return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, np.int32 if i == 0 else np.int64)) for i, x in enumerate(columns)), pa.nulls(n, pa.binary()) if text is None else text], FOUND_NAMES)


def _numbers(rows: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [rows.column(n).to_numpy() for n in names]


def recut(rows: pa.RecordBatch, s: SpanSettings, mer: int) -> Iterator[pa.RecordBatch]:
    """Entries cut anew by longer minimisers, for the next round."""
    for lo in range(0, len(rows), 2048):
        part = rows.slice(lo, 2048)
        c, size = _codes_of(part.column("text"))
        k = cut(_prefix(c), size, s.length, mer)
        begin = np.cumsum(size) - size
        lid, doc, start, off, docs = (x[k.text] for x in _numbers(part, "lid", "doc", "start", "off", "docs"))
        raw = c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        yield _found(2, k.least, lid, doc, start, off + k.at - begin[k.text], docs, _packed(raw, _byte_places(c), k.at, k.windows + s.length - 1))


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in held]) for i in range(held[0].num_columns)], PACKED_NAMES)


def sorted_windows(batches: Iterator[pa.RecordBatch], s: SpanSettings, longer: int | None) -> Iterator[pa.RecordBatch]:
    """Shared runs of packed rows that come in the order of their minimisers.

    longer: the next round's minimiser length, for minimisers with more than `heavy` entries.
    """
    held: list[pa.RecordBatch] = []
    hot, size = None, 0
    for batch in batches:
        if batch.column("text").null_count:
            spots = batch.filter(pc.is_null(batch.column("text")))
            lid, doc, start = _numbers(spots, "lid", "doc", "start")
            none = np.zeros(len(lid), np.int64)
            yield _found(1, none, lid, doc, start, none, none)
            batch = batch.filter(pc.is_valid(batch.column("text")))
        if hot is not None and len(batch):
            upto = int(np.searchsorted(batch.column("m").to_numpy(), hot, "right"))
            if upto:
                yield from recut(batch.slice(0, upto), s, longer)
            batch = batch.slice(upto)
            if len(batch):
                hot = None
        if not len(batch):
            continue
        held.append(batch)
        size += batch.column("text").nbytes
        if size < CHUNK:
            continue
        whole = _joined(held)
        m = whole.column("m").to_numpy()
        last = int(np.searchsorted(m, m[-1], "left"))
        yield from _complete(whole.slice(0, last), s)
        tail = whole.slice(last)
        held, size = [tail], 0
        if longer and len(tail) > s.heavy:
            yield from recut(tail, s, longer)
            hot, held = m[-1], []
    if held:
        whole = _joined(held)
        m = whole.column("m").to_numpy()
        many = np.zeros(len(m), bool)
        if longer:  # small partitions end before their size was looked at
            _, which, often = np.unique(m, return_inverse=True, return_counts=True)
            many = (often > s.heavy)[which.ravel()]
        if many.any():
            yield from recut(whole.filter(pa.array(many)), s, longer)
            whole = whole.filter(pa.array(~many))
        yield from _complete(whole, s)


def _complete(rows: pa.RecordBatch, s: SpanSettings) -> Iterator[pa.RecordBatch]:
    """The shared runs among all entries of some minimisers, in chunks of whole minimisers with bounded text."""
    m, docs = _numbers(rows, "m", "docs")
    same = m[1:] == m[:-1]
    keep = np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])) | (docs > 1)) if len(m) else []
    lo = 0
    while lo < len(keep):
        hi = min(len(keep), lo + max(1, CHUNK // (2 * s.length)))
        while hi < len(keep) and m[keep[hi]] == m[keep[hi - 1]]:
            hi += 1
        e = rows.take(pa.array(keep[lo:hi]))
        lo = hi
        c, size = _codes_of(e.column("text"))
        at = np.cumsum(size) - size
        n = size - s.length + 1
        entry = np.repeat(np.arange(len(n)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + at[entry]
        yield from _runs(c, _every_hash(_prefix(c), s.length)[place], entry, place, at, e, s.length)


def _runs(c: np.ndarray, h: np.ndarray, entry: np.ndarray, place: np.ndarray, at: np.ndarray, e: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    """Windows that stand in two documents or more, as runs of one entry with one set of documents.

    h: a name of each window. Where two windows of one name differ, which the comparison of every
    window with its group's first shows, the names are made anew from the characters.
    """
    lid, doc, start, first_off, docs = _numbers(e, "lid", "doc", "start", "off", "docs")
    order = np.argsort(h)
    sorted_h = h[order]
    new = np.concatenate(([True], sorted_h[1:] != sorted_h[:-1]))
    group = np.cumsum(new) - 1
    own = entry[order]
    several = np.zeros(int(group[-1]) + 1, bool)
    several[group[docs[own] > 1]] = True
    several[group[doc[own] != doc[own[new]][group]]] = True
    take = np.flatnonzero(several[group])
    if not len(take):
        return
    w, g = order[take], group[take]
    lead = order[new][g]
    who = np.where(lid[entry[w]] != 0, lid[entry[w]], doc[entry[w]])
    by = np.lexsort((who, g))
    sg, sw = g[by], who[by]
    first = np.concatenate(([True], sg[1:] != sg[:-1]))
    fresh = first | np.concatenate(([True], sw[1:] != sw[:-1]))
    names = np.where(fresh, mix(sw.view(np.uint64) ^ SECOND), np.uint64(0))
    family = np.empty(len(w), np.int64)
    family[by] = np.repeat(mix(np.add.reduceat(names, np.flatnonzero(first), dtype=np.uint64)).view(np.int64), np.diff(np.concatenate((np.flatnonzero(first), [len(sg)]))))
    by = np.argsort(place[w])  # by entry and offset
    w, family, lead = w[by], family[by], lead[by]
    go_on = (entry[w][1:] == entry[w][:-1]) & (place[w][1:] == place[w][:-1] + 1)
    # Stretches whose firsts go on side by side are compared as a whole.
    together = go_on & (entry[lead][1:] == entry[lead][:-1]) & (place[lead][1:] == place[lead][:-1] + 1)
    b = np.flatnonzero(np.concatenate(([True], ~together)))
    upto = np.concatenate((b[1:], [len(w)])) - 1
    for x, y, z in zip(place[w[b]].tolist(), place[lead[b]].tolist(), (place[w[upto]] + length).tolist()):
        if x != y and not np.array_equal(c[x:z], c[y : y + z - x]):
            known: dict[bytes, int] = {}
            exact = np.array([known.setdefault(c[p : p + length].tobytes(), len(known)) for p in place.tolist()], np.uint64)
            yield from _runs(c, exact, entry, place, at, e, length)
            return
    b = np.flatnonzero(np.concatenate(([True], ~(go_on & (family[1:] == family[:-1])))))
    v = entry[w[b]]
    yield _found(0, family[b], lid[v], doc[v], start[v], first_off[v] + place[w[b]] - at[v], np.diff(np.concatenate((b, [len(w)]))))


def shared_windows(docs: DataFrame, s: SpanSettings) -> DataFrame:
    """Runs of shared windows, and places of collapsed entries, written to the shared folder.

    kind 0: (family, lid, doc, start, off, windows): windows `off` .. of an entry, all in the same
    documents; `family` names those documents; lid 0 means the entry stands at doc, start alone.
    kind 1: (lid, doc, start): a place of a collapsed entry.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, begins in _pieces(batch, s.length):
                yield from filter(None, super_kmers(ids, texts, begins, s))

    mers, found = s.mers(), []
    packed = spread(docs).mapInArrow(pack, PACKED)
    for longer in [*mers[1:], None]:
        count = lambda batches, longer=longer: sorted_windows(batches, s, longer)
        found.append(materialize(packed.repartition("m").sortWithinPartitions("m").mapInArrow(count, FOUND), "spans"))
        more = found[-1].where("kind = 2")
        if more.isEmpty():
            break
        packed = more.select(F.col("family").alias("m"), "lid", "doc", "start", "off", F.col("windows").cast("int").alias("docs"), "text")
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionAll(f)
    return whole.where("kind != 2").drop("text")


def placed_runs(found: DataFrame) -> DataFrame:
    """Every shared run at every place it stands: (family, doc_id, start, windows)."""
    runs = found.where("kind = 0")
    own = runs.where("lid = 0").select("family", F.col("doc").alias("doc_id"), (F.col("start") + F.col("off")).alias("start"), "windows")
    places = found.where("kind = 1").select("lid", F.col("doc").alias("doc_id"), F.col("start").alias("place")).distinct()
    spread = runs.where("lid != 0").select("family", "lid", "off", "windows").distinct().join(places, "lid")
    return own.unionAll(spread.select("family", "doc_id", (F.col("place") + F.col("off")).alias("start"), "windows"))


def sharing_families(docs: DataFrame, settings: SpanSettings = SpanSettings()) -> DataFrame:
    """(family, doc_id): documents that all hold a common run of at least `length` code points; linear in the shared
    text where pairs are quadratic. A document stands in one family for each set of documents it shares a run with."""
    runs = placed_runs(shared_windows(docs.select("doc_id", "text"), settings))
    return runs.select("family", "doc_id").distinct()


def sharing_pairs(docs: DataFrame, settings: SpanSettings = SpanSettings()) -> DataFrame:
    """Pairs of documents with a common run of at least `length` code points: (doc_id_1, doc_id_2).

    Null ids, null texts and texts shorter than the length share nothing; repeated rows of one
    document count once; very long texts are cut nowhere. An empty table gives no pair. Other
    columns are ignored.
    """
    holders = materialize(sharing_families(docs, settings), "holders")
    x, y = holders.select("family", F.col("doc_id").alias("doc_id_1")), holders.select("family", F.col("doc_id").alias("doc_id_2"))
    return x.join(y, "family").where("doc_id_1 < doc_id_2").select("doc_id_1", "doc_id_2").distinct()


def shared_coverage(docs: DataFrame, settings: SpanSettings = SpanSettings()) -> DataFrame:
    """How much of each document stands in others: (doc_id, n_chars, spans, shared_chars, share).

    Every document with an id has a row; null and empty texts have 0 characters and a null share.
    Overlapping and touching runs are merged before counting.
    """
    docs = docs.select("doc_id", "text")
    runs = placed_runs(shared_windows(docs, settings)).select("doc_id", "start", (F.col("start") + F.col("windows") + settings.length - 1).alias("end")).distinct()
    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(-1))
    merged = runs.select("doc_id", (F.col("end") > reach).alias("adds"), (F.col("start") > reach).cast("int").alias("opens"), F.greatest("end", reach).alias("e"), F.greatest("start", reach).alias("b"))
    per = merged.groupBy("doc_id").agg(F.sum("opens").alias("spans"), F.sum(F.when(F.col("adds"), F.col("e") - F.col("b")).otherwise(0)).alias("shared_chars"))
    sizes = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.char_length("text"), F.lit(0))).cast("long").alias("n_chars"))
    both = sizes.join(per, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("spans", F.lit(0)).cast("long").alias("spans"), F.coalesce("shared_chars", F.lit(0)).cast("long").alias("shared_chars"))
    return both.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")))
