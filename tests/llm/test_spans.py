"""Shared spans against brute force, also with minimisers cut anew through all rounds."""

import random

import pytest
from pyspark.sql import Row

from rillstone.llm.spans import SpanSettings, shared_coverage, sharing_pairs

N = 40


def corpus():
    rng = random.Random(8)
    letters = "abcdefghij éü漢😀\n"
    new = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [new(rng.randint(N, 150)) for _ in range(6)]
    docs = [(i, new(rng.randint(0, 200)) + (rng.choice(passages) if i % 2 else "") + new(rng.randint(0, 120))) for i in range(60)]
    docs += [(100, docs[1][1]), (101, docs[1][1]), (102, docs[1][1]), (103, None), (104, ""), (105, "a" * 5000), (106, "b" + "a" * 90), (107, passages[0][: N - 1]), (108, passages[0][:N])]
    docs += [(109, new(30_000) + passages[1] + new(20_000)), (110, passages[2] + passages[2])]
    return docs


def windows(text):
    return {text[i : i + N] for i in range(len(text or "") - N + 1)} if text else set()


@pytest.mark.parametrize("heavy", [20_000, 3, 1])
def test_pairs_and_coverage_equal_brute_force(spark, heavy):
    docs = corpus()
    df = spark.createDataFrame([Row(doc_id=i, text=t, windows="clash", lid=3) for i, t in docs] + [Row(doc_id=docs[3][0], text=docs[3][1], windows="", lid=0), Row(doc_id=None, text=docs[1][1], windows="", lid=0)])
    s = SpanSettings(length=N, mer=9, heavy=heavy)
    own = {i: windows(t) for i, t in docs}
    ids = sorted(own)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if own[a] & own[b]}
    assert {tuple(r) for r in sharing_pairs(df, s).collect()} == want and want
    holders = {}
    for i, ws in own.items():
        for w in ws:
            holders.setdefault(w, set()).add(i)
    rows = {r.doc_id: r for r in shared_coverage(df, s).collect()}
    assert set(rows) == set(own)
    for i, t in docs:
        hit = set()
        for k in range(len(t or "") - N + 1):
            if len(holders[t[k : k + N]]) > 1:
                hit.update(range(k, k + N))
        assert rows[i].shared_chars == len(hit), i
        assert rows[i].n_chars == len(t or "")


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sharing_pairs(none).count() == 0 and shared_coverage(none).count() == 0


def test_segments_of_very_long_texts(monkeypatch):
    import pyarrow as pa

    from rillstone.llm import spans

    rng = random.Random(9)
    new = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    shared = new(75)
    docs = [(1, new(130) + shared + new(500)), (2, new(333) + shared), (3, new(700))]
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs]})
    monkeypatch.setattr(spans, "CHUNK", 64)
    seen = [(i, t, b) for ids, texts, begins in spans._pieces(batch, N) for i, t, b in zip(ids, texts, begins)]
    for i, whole in docs:
        starts = sorted(b + k for j, t, b in seen if j == i for k in range(len(t) - N + 1))
        assert starts == list(range(len(whole) - N + 1))
        assert all(whole[b : b + len(t)] == t for j, t, b in seen if j == i)


def found_pairs(docs, s, chunk=500):
    """The operator's stages on Arrow batches alone: pairs of documents of one family."""
    import pyarrow as pa

    from rillstone.llm import spans

    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs]})
    packed = [x for p in spans._pieces(batch, s.length) for x in spans.super_kmers(*p, s) if x is not None]
    rows, rounds = [], 0
    for longer in [*s.mers()[1:], None]:
        sent = pa.Table.from_batches(packed).sort_by("m").to_batches(max_chunksize=chunk)
        out = pa.Table.from_batches(list(spans.sorted_windows(iter(sent), s, longer)), pa.schema([(n, pa.binary() if n == "text" else pa.int32() if n == "kind" else pa.int64()) for n in spans.FOUND_NAMES])).to_pylist()
        rows += out
        more = [r for r in out if r["kind"] == 2]
        if not more:
            break
        rounds += 1
        packed = pa.Table.from_pydict({"m": [r["family"] for r in more], **{n: [r[n] for r in more] for n in ("lid", "doc", "start", "off")}, "docs": pa.array([r["windows"] for r in more], pa.int32()), "text": pa.array([r["text"] for r in more], pa.binary())}).to_batches()
    at = {}
    for r in rows:
        if r["kind"] == 1:
            at.setdefault(r["lid"], set()).add(r["doc"])
    holders = {}
    for r in rows:
        if r["kind"] == 0:
            holders.setdefault(r["family"], set()).update(at[r["lid"]] if r["lid"] else {r["doc"]})
    return {(a, b) for ds in holders.values() for a in ds for b in ds if a < b}, rounds


def test_one_minimiser_in_a_third_of_the_documents():
    """Boilerplate with other text around it: its minimisers are cut anew in every round, and nothing is lost."""
    rng = random.Random(12)
    new = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    plate = new(N - 4)  # below the length: shared only with some of the text around it
    docs = [(i, new(60) + (rng.choice("xy") + plate + rng.choice("xyz") + new(3) if i % 3 == 0 else new(50)) + new(60)) for i in range(240)]
    own = {i: windows(t) for i, t in docs}
    want = {(a, b) for a in own for b in own if a < b and own[a] & own[b]}
    for heavy, chunk in ((20_000, 500), (10, 500), (10, 7)):
        got, rounds = found_pairs(docs, SpanSettings(length=N, mer=9, heavy=heavy), chunk)
        assert got == want, heavy
        assert rounds == 0 if heavy > 1000 else rounds > 1


def test_colliding_hashes_change_nothing(monkeypatch):
    """With hashes of 6 bits nearly all windows collide, and the characters decide."""
    from rillstone.llm import spans

    docs = corpus()[:30]
    real = spans._every_hash
    own = {i: windows(t) for i, t in docs}
    want = {(a, b) for a in own for b in own if a < b and own[a] & own[b]}
    monkeypatch.setattr(spans, "_every_hash", lambda sums, length: real(sums, length) & spans.np.uint64(63) if length == N else real(sums, length))
    assert found_pairs(docs, SpanSettings(length=N, mer=9))[0] == want
