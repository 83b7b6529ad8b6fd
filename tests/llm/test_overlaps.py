"""Near-duplicates against brute force, and their defined results for odd input."""

import random
import re

import pytest
from pyspark.sql import Row

from rillstone.llm import overlaps
from rillstone.llm.lsh import Settings, minhash, miss_probability, near_duplicates, one_permutation

WORDS = [f"w{i}" for i in range(4000)]


def triples(text):
    w = re.findall(r"[a-z0-9]+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def alike(a, b):
    return bool(a and b) and 2 * len(a & b) >= len(a | b)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i : i + rng.choice((0, 1, 1))] = [rng.choice(WORDS)]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows = []
    for k in range(60):
        base = [rng.choice(WORDS) for _ in range(rng.randint(12, 90))]
        for j in range(rng.choice((1, 1, 2, 5))):
            text = " ".join(edited(rng, base, rng.randrange(0, 6)))
            rows.append((f"id-{k:03d}-{j}", text.upper() if j == 1 else text))
    rows += [("copy-a", rows[0][1]), ("copy-b", rows[0][1]), ("short", "two words"), ("empty", ""), ("none", None), ("odd", "é ü — ... 漢字")]
    return rows


def brute(rows):
    sets = {i: triples(t) for i, t in rows}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if alike(sets[a], sets[b])}


@pytest.mark.parametrize("signature", ["oph", "minhash"])
def test_pairs_equal_brute_force(spark, corpus, signature):
    rows = [("f", i, 0, [t], "clash", 1) for i, t in corpus]
    rows += rows[:5]  # redelivered
    found = near_duplicates(spark.createDataFrame(rows, "field string, id string, side int, parts array<string>, cls string, component int"), Settings(threshold=0.5, words=3, signature=signature)).record_pairs()
    assert {(r.id_1, r.id_2) for r in found.collect()} == brute(corpus)


def test_defaults_are_five_words_and_eight_tenths():
    assert (Settings().words, Settings().threshold) == (5, 0.8)
    assert miss_probability(overlaps.SMALL_EDITS, 0.6) < 1e-4


def test_cross_split_pairs_and_report(spark, corpus):
    splits = ["train", " Val", "TEST ", None, "", "other"]
    miu = [Row(id=i, split=splits[k % 6], user_natural_language=t, clean_context=[Row(id="clean_1", content=t, authorized_by=None), None] if k % 2 else None) for k, (i, t) in enumerate(corpus)]
    df = spark.createDataFrame(miu, "id string, split string, user_natural_language string, clean_context array<struct<id:string,content:string,authorized_by:string>>")
    side = {r.id: {"train": 1, "val": 2, "test": 2}.get((r.split or "").strip().lower()) for r in miu}
    want = {p for p in brute(corpus) if side[p[0]] and side[p[1]] and side[p[0]] != side[p[1]]}
    pairs = overlaps.cross_split(df).record_pairs(cross=True).select("id_1", "id_2").distinct()
    assert {tuple(r) for r in pairs.collect()} == want and want
    sidecar = spark.createDataFrame([], "record_id string, attempt int, source_packet struct<facts:array<struct<source_ref:struct<dataset:string>>>>")
    report = overlaps.overlap_report(pairs, df, sidecar).collect()
    assert {r.source for r in report} == {"none"} and {r.split for r in report} <= {"val", "test"}
    assert sum(r.pairs for r in report) == len(want)


def test_classes_give_a_row_per_text(spark, corpus):
    units = spark.createDataFrame([Row(field="f", id=i, side=0, parts=[t]) for i, t in corpus], "field string, id string, side int, parts array<string>")
    rows = {r.id: r for r in near_duplicates(units, Settings(threshold=0.5, words=3)).classes().collect()}
    assert {i for i, t in corpus if triples(t)} == set(rows)
    assert len({rows[i].group_id for i in ("copy-a", "copy-b", corpus[0][0])}) == 1
    for a, b in brute(corpus):
        assert rows[a].group_id == rows[b].group_id


def test_empty_and_hot_groups(spark):
    schema = "field string, id string, side int, parts array<string>"
    assert near_duplicates(spark.createDataFrame([], schema), Settings()).record_pairs().count() == 0
    # A third of the rows are one text, copied.
    text = " ".join(WORDS[:50])
    rows = [("f", f"c{i:03d}", 0, [text]) for i in range(40)] + [("f", f"o{i:03d}", 0, [" ".join(WORDS[i * 40 + 60 : i * 40 + 100])]) for i in range(80)]
    nd = near_duplicates(spark.createDataFrame(rows, schema), Settings())
    assert nd.pairs.count() == 0 and nd.record_pairs().count() == 40 * 39 // 2


def test_signatures_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    common = rng.integers(0, 2**63, 60, dtype=np.uint64)
    a, b = (np.unique(np.concatenate((common, rng.integers(0, 2**63, 40, dtype=np.uint64)))) for _ in range(2))
    both, offsets = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
    for sig in (minhash(both, offsets, 2000, 9), one_permutation(both, offsets, 2000, 9)):
        assert abs((sig[0] == sig[1]).mean() - 60 / 140) < 0.06
    tiny = np.array([5, 9, 5], np.uint64)
    sig = one_permutation(tiny, np.array([0, 2, 3]), 640, 1)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.08


def templated(rng, n, shared=40, own=60):
    """Texts that share a template of 40 of 100 words (similarity near 0.25), some with a near copy."""
    template = [rng.choice(WORDS) for _ in range(shared)]
    rows = []
    for k in range(n):
        words = template + [f"x{rng.randrange(10**9)}" for _ in range(own)]
        rows.append((f"t-{k:05d}", " ".join(words)))
        if k % 10 == 0:  # a copy with a third of its own words changed
            for i in rng.sample(range(shared, shared + own), 8):
                words[i] = f"y{rng.randrange(10**9)}"
            rows.append((f"u-{k:05d}", " ".join(words)))
    return rows


def test_prefix_candidates_lose_nothing_and_skip_the_template(spark):
    """One group of 440 texts on a template: every alike pair is a candidate, and few others are."""
    from rillstone.llm.lsh import prefix_candidates

    rows = templated(random.Random(5), 400)
    names = {t: i for i, t in enumerate(sorted({t for _, x in rows for t in triples(x)}))}
    sets = [(1, k, 0, len(s := {names[t] for t in triples(x)}), sorted(s)) for k, (_, x) in enumerate(rows)]
    df = spark.createDataFrame(sets, "comp long, cls long, sides int, size int, shingles array<long>")
    got = {(r.a, r.b) for r in prefix_candidates(df, Settings(threshold=0.5, words=3)).collect()}
    each = [set(s[4]) for s in sets]
    want = {(i, j) for i in range(len(each)) for j in range(i + 1, len(each)) if 2 * len(each[i] & each[j]) >= len(each[i] | each[j])}
    assert want and want <= got and len(got) < 4 * len(want)


@pytest.mark.parametrize("signature", ["oph", "minhash"])
def test_crowded_buckets_keep_alike_texts(spark, signature):
    """Template texts fill the buckets with unlike centres; the near copies among them are still found."""
    rows = templated(random.Random(6), 1500)
    units = spark.createDataFrame([("f", i, 0, [t]) for i, t in rows], "field string, id string, side int, parts array<string>")
    got = {(r.id_1, r.id_2) for r in near_duplicates(units, Settings(threshold=0.5, words=3, signature=signature)).record_pairs().collect()}
    sets = {i: triples(t) for i, t in rows}
    want = {(a, b) for a, b in ((f"t-{k:05d}", f"u-{k:05d}") for k in range(0, 1500, 10)) if alike(sets[a], sets[b])}
    assert len(want) > 140 and len(want & got) >= 0.99 * len(want)


def test_large_groups_equal_brute_force(spark, corpus, monkeypatch):
    from rillstone.llm import lsh

    monkeypatch.setattr(lsh, "SMALL_GROUP", 1)
    rows = [("f", i, 0, [t]) for i, t in corpus]
    found = near_duplicates(spark.createDataFrame(rows, "field string, id string, side int, parts array<string>"), Settings(threshold=0.5, words=3)).record_pairs()
    assert {(r.id_1, r.id_2) for r in found.collect()} == brute(corpus)
