"""Components, ranks, selection, merging, packing, retrieval and sequences against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from rillstone.functions import hashing, sequences, stats
from rillstone.operators import merging, packing, retrieval, rewards, selection
from rillstone.operators.graph import connected_components
from rillstone.operators.ranking import blocked_rank


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(180)] + [("hub", f"h{i:03d}") for i in range(200)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("loop", "loop"), ("x", None), (None, None)]
    root = {}
    find = lambda a: a if root.setdefault(a, a) == a else find(root[a])
    for a, b in edges:
        if a and b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "src string, dst string, node int")
    got = connected_components(df).collect()
    assert {r.node: r.component for r in got} == {a: find(a) for a in root} and len(got) == len(root)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_go_on_until_they_settle(spark):
    """A path of 300 nodes in shuffled order, and names against numbers."""
    names = list(range(300))
    random.Random(4).shuffle(names)
    path = spark.createDataFrame(list(zip(names, names[1:])), "src long, dst long")
    assert {r.component for r in connected_components(path).collect()} == {0}
    named = path.select(F.concat(F.lit("n"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("dst").cast("string")).alias("dst"))
    assert {r.component for r in connected_components(named).collect()} == {"n0"}


def test_blocked_rank(spark, monkeypatch):
    from rillstone.operators import ranking

    monkeypatch.setattr(ranking, "BLOCK_ROWS", 40)
    assert [ranking.block_bits(n) for n in (0, 1, 40, 41, 80, 81, 541)] == [0, 0, 0, 1, 1, 2, 4]
    rows = [(k, i) for k in ("a", "b", None) for i in range(500 if k == "a" else 20)]
    out = blocked_rank(spark.createDataFrame(rows, "k string, i int"), ["k"], ["i"], 3, "rank").collect()
    by = defaultdict(list)
    for r in out:
        by[r.k].append(r["rank"])
    assert {k: sorted(v) for k, v in by.items()} == {"a": list(range(500)), "b": list(range(20)), None: list(range(20))}
    again = blocked_rank(spark.createDataFrame(rows[::-1], "k string, i int"), ["k"], ["i"], 3, "rank", rows=60)
    assert {(r.k, r.i, r["rank"]) for r in out} == {(r.k, r.i, r["rank"]) for r in again.collect()}


def test_positions_slices_and_shards(spark):
    df = spark.createDataFrame([(i,) for i in random.Random(2).sample(range(1000), 300)], "i int")
    order = sorted(r.i for r in df.collect())
    take = lambda a, b: sorted(r.i for r in selection.row_slice(df, ["i"], a, b).collect())
    assert take(3, 10) == order[3:10] and take(-5, None) == order[-5:] and take(None, -290) == order[:-290]
    assert sorted(r.i for r in selection.shard(df, ["i"], 1, 4).collect()) == order[1::4]
    assert selection.trim_to_multiple(df, ["i"], 64).count() == 256
    assert sorted((r.group_index, r["index"]) for r in selection.replicated(df.where("i < 100"), 3, ["i"]).collect()) == [(i // 3, i) for i in range(3 * sum(x < 100 for x in order))]


def test_balanced_labels_and_quotas(spark):
    rows = [(f"r{i}", "x" if i < 100 else "y") for i in range(147)]
    got = selection.balanced_labels(spark.createDataFrame(rows, "id string, g string"), ["g"], "id", ["o1", "o2", "o3"]).collect()
    for g in "xy":
        n = Counter(r.target for r in got if r.g == g)
        assert max(n.values()) - min(n.values()) <= 1
    q = spark.range(1).select(selection.largest_remainder(F.lit(10), {"a": 0.4, "b": 0.35, "c": 0.25}).alias("q")).first().q
    assert q == {"a": 4, "b": 4, "c": 2}
    sched = selection.task_schedule(spark.range(200).withColumnRenamed("id", "i"), "i", 7, 0.3, 200).collect()
    assert sum(r.task == "EIL" for r in sched) == 60
    with pytest.raises(ValueError):
        selection.quota_count(10, 1.0)


def test_target_flow_sums(spark):
    rng = random.Random(9)
    for _ in range(8):
        b = [rng.randint(2, 9) for _ in range(3)]
        n = sum(b)
        q = [n // 3 + (i < n % 3) for i in range(3)]
        f = selection.target_flow([F.lit(x) for x in b], [F.lit(x) for x in q], F.lit(rng.randrange(100)))
        r = spark.range(1).select(*[v.alias(k) for k, v in f.items()]).first().asDict()
        if all(x <= n - x for x in b):
            assert all(v >= 0 for v in r.values())
        assert [r["n12"] + r["n13"], r["n21"] + r["n23"], r["n31"] + r["n32"]] == b
        assert [r["n21"] + r["n31"], r["n12"] + r["n32"], r["n13"] + r["n23"]] == q


def test_merging(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "y"), (3, None, "z")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "B", None), (9, "q", "q")], "k int, v string, w string")
    assert {tuple(r) for r in merging.replaced(old, new, "k").collect()} == {(1, "a", None), (2, "B", None), (3, None, "z")}
    assert {tuple(r) for r in merging.patched(old, new, "k", ["v", "w"]).collect()} == {(1, "a", None), (2, "B", "y"), (3, None, "z")}
    assert {(r.k, r.problem) for r in merging.conflicts(new, old, "k", ["v"]).collect()} == {(1, "missing"), (3, "missing"), (9, "unexpected"), (2, "changed")}
    assert [r.k for r in merging.append_absent(new.unionAll(new), old, "k").collect()] == [9]
    with pytest.raises(ValueError):
        merging.require_unique(new.unionAll(new), "k")
    with pytest.raises(ValueError):
        merging.covered([old], new, "k")
    assert merging.covered([old.where("k < 3"), old.where("k = 3")], old.select("k"), "k").count() == 3
    with pytest.raises(ValueError):
        merging.require_single(old, "v")
    with pytest.raises(ValueError):
        merging.optimistic_merge(old, new, "k", "v", ["w"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=4, max_size=40), st.integers(2, 4))
def test_packers(lengths, k):
    bins = packing.first_fit(lengths, 64)
    load = Counter()
    for n, b in zip(lengths, bins):
        load[b] += n
    assert all(v <= 64 for v in load.values())
    for parts in (packing.differencing(lengths, k), packing.greedy(lengths, k)):
        sums = [sum(n for n, p in zip(lengths, parts) if p == i) for i in range(k)]
        assert sum(sums) == sum(lengths) and max(sums) - min(sums) <= max(lengths)
    even = lengths[: len(lengths) // k * k]
    assert set(Counter(packing.differencing(even, k, True)).values()) == {len(even) // k}


def test_packs_round_trip(spark):
    rows = [(i, i % 3, list(range(i % 7))) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, pack int, tokens array<int>")
    packs = packing.joined_packs(df, ["pack"], "i", "tokens")
    back = {(r.pack, r.seq): list(r.tokens) for r in packing.split_packs(packs, ["pack"]).collect()}
    for pack in range(3):
        own = [t for i, p, t in rows if p == pack]
        assert [back[pack, s] for s in range(len(own))] == own
    p = packing.packed(df.select("i", "pack", F.size("tokens").alias("n")), "pack", "i", "n", "first_fit", 8)
    assert p.count() == 40 and p.groupBy("pack", "bin").agg(F.sum("n").alias("s")).agg(F.max("s")).first()[0] <= 8
    assert packing.chunked(df.select("i", "pack", F.size("tokens").alias("n")), "pack", "i", "n", 8).groupBy("pack", "chunk").agg(F.sum("n").alias("s")).agg(F.max("s")).first()[0] <= 8


def test_topk(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(500, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = retrieval.inner_product_topk(df, df.where("id % 50 = 0"), "id", "v", 4).collect()
    for q in (0, 50, 100):
        want = sorted(((-sum(a * b for a, b in zip(rows[q][1], v)), i) for i, v in rows if v))[:4]
        assert [r.id for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == [i for _, i in want]
    assert retrieval.inner_product_topk(df, df.where("id < 0"), "id", "v", 4).count() == 0
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue"), (4, None), (5, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "red dog")], "doc_id long, text string")
    assert [r.doc_id for r in retrieval.bm25_topk(docs, asked, 3).orderBy("rank").collect()] == [2, 1]
    p = retrieval.longest_prefix(docs, spark.createDataFrame([("re",), ("red f",)], "p string"), "doc_id", "text", "p", [2, 5])
    assert {r.doc_id: r.p for r in p.collect()} == {1: "red f", 2: "re", 3: None, 4: None, 5: None}


def test_bm25_makes_no_rows_of_pairs(spark, monkeypatch):
    """Against brute force over blocks of queries and documents: ties, repeated and null keys, dense and rare terms."""
    monkeypatch.setattr(retrieval, "TERM_QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "DOCUMENT_BLOCK", 5)
    rng = random.Random(11)
    words = ["the", "of"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [40, 20] + [1] * 60, k=rng.randrange(1, 25))) for _ in range(150)]
    texts += [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts[:50]] + [None, "", "\u00e9", "only here"]
    keys = [*range(len(texts))]
    keys[60:64], keys[70], keys[71] = [7, 7, 8, 8], None, None
    df = spark.createDataFrame(list(zip(keys, texts)), "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(k, t) for k, t in zip(keys, texts) if k is None or k % 5 < 3], "doc_id long, text string")
    got = retrieval.bm25_topk(df, asked, 4)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    tokens = [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]
    avg, postings, queries = sum(map(len, tokens)) / len(texts), Counter(), defaultdict(set)
    for key, w in zip(keys, tokens):
        postings.update((key, len(w), t) for t in w)
        if key is None or key % 5 < 3:
            queries[key] |= set(w)
    df_of = Counter(t for _, _, t in postings)
    want = set()
    for q, terms in queries.items():
        score = defaultdict(list)
        for (key, n, t), tf in postings.items():
            if t in terms:
                score[key].append(math.log(1 + (len(texts) - df_of[t] + 0.5) / (df_of[t] + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * n / avg)))
        best = sorted((-round(math.fsum(s), 9), key is None, key or 0, key) for key, s in score.items())[:4]
        want |= {(q, key, r, -round(s, 6)) for r, (s, _, _, key) in enumerate(best, 1)}
    rows = [(r["query"], r.doc_id, r.rank, -round(-r.score, 6)) for r in got.collect()]
    assert len(rows) == len(want) and {x[:3] for x in rows} == {x[:3] for x in want}
    assert all(abs(a[3] - b[3]) < 1e-5 for a, b in zip(sorted(rows, key=str), sorted(want, key=str)))
    assert retrieval.bm25_topk(df.where("false"), df.where("false"), 4).count() == 0
    assert retrieval.bm25_topk(df, df.where("doc_id < 0"), 4).count() == 0


def test_prefixes_of_every_length(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("ab\u00e9\U0001f600") for _ in range(2500))
    texts = [long[: rng.randrange(2, 2500)] + rng.choice("xyz") * rng.randrange(3) for _ in range(60)] + [long + "p", long + "q", "twice", "twice", "alone", "", "", None, "\u00e9a", "\U0001f600b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    shared = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = {i: max((shared(t, u) for j, u in enumerate(texts) if j != i and u is not None), default=0) or None if t is not None else None for i, t in enumerate(texts)}
    got = retrieval.shared_prefix(df, "i", "t").collect()
    assert {r.i: r.matched for r in got} == want and len(got) == len(texts) and want[60] == 2500
    keys = [long[:n] for n in (1, 7, 300, 1800)] + ["twi", "twice more", "", None]
    found = retrieval.longest_prefix(df, spark.createDataFrame([(k,) for k in keys], "p string"), "i", "t", "p").collect()
    assert {r.i: r.p for r in found} == {i: max((k for k in keys if k and t is not None and t.startswith(k)), key=len, default=None) for i, t in enumerate(texts)}


def test_sequences(spark):
    rng = random.Random(4)
    n = 9
    r, v, lp, lr = ([rng.uniform(-1, 1) for _ in range(n)] for _ in range(4))
    mask = [1, 1, 0, 1, 1, 0, 1, 1, 0]
    df = spark.createDataFrame([(r, v, lp, lr, mask)], "r array<double>, v array<double>, lp array<double>, lr array<double>, m array<int>")
    out, last = [0.0] * n, 0.0
    for t in reversed(range(n)):
        last = r[t] + 0.9 * (v[t + 1] if t < n - 1 else 0.0) - v[t] + 0.9 * 0.8 * last
        out[t] = last
    c = F.col
    got = df.select(
        sequences.gae(c("r"), c("v"), 0.9, 0.8).alias("gae"), sequences.discounted_returns(F.lit(2.0), c("r"), c("m"), 0.1, 0.5).alias("ret"), sequences.kl(c("lp"), c("lr"), "k3").alias("k3"), sequences.masked_mean(c("lp"), c("m")).alias("mean"),
        sequences.importance_weights(c("lp"), c("lr"), c("m"), "sequence", "clip", 0.5, 2.0).alias("w"), sequences.importance_weights(c("lp"), c("lr"), c("m"), veto=1.0).alias("veto"), sequences.response_length(c("m")).alias("len"), sequences.tail(c("r"), F.lit(3)).alias("tail"),
        sequences.policy_loss(c("lp"), c("lr"), 0.2, 0.3, 2.0).alias("loss"), sequences.value_loss(c("v"), c("r"), c("lp"), 0.1).alias("vl"),
    ).first()
    assert got.gae == pytest.approx(out)
    ret, run = [0.0] * n, 0.0
    for t in reversed(range(n)):
        run = -0.1 * r[t] + (2.0 if t == 7 else 0.0) + 0.5 * run
        ret[t] = run
    assert got.ret == pytest.approx(ret)
    assert got.k3 == pytest.approx([math.exp(b - a) - 1 + (a - b) for a, b in zip(lp, lr)])
    assert got["mean"] == pytest.approx(sum(a * m for a, m in zip(lp, mask)) / 6)
    w = min(max(math.exp(sum((a - b) * m for a, b, m in zip(lp, lr, mask))), 0.5), 2.0)
    assert got.w == pytest.approx([w * m for m in mask])
    assert got.veto == [0.0] * n and got["len"] == n and got["tail"] == r[-3:]
    for x, p, a in zip(got.loss, lp, lr):
        free, held = -math.exp(-p) * a, -min(max(math.exp(-p), 0.8), 1.3) * a
        want = max(free, held)
        assert x.loss == pytest.approx(min(-2.0 * a, want) if a < 0 else want) and x.clipped == int(held > free)
    assert len(got.vl) == n
    assert spark.range(1).select(sequences.discounted_returns(F.lit(1.0), F.array(F.lit(1.0)), F.array(F.lit(0)), 0.1, 0.9).alias("x")).first().x is None


def test_written_reward_values(spark):
    slots = [Row(id=x, severity=x) for x in ("high", "med", "low")]
    cases = [({}, 0.0), ({"low": 1.0}, 0.33), ({"med": 1.0, "low": 1.0}, 0.67), ({"high": 1.0}, 0.67)]
    df = spark.createDataFrame([(slots, s) for s, _ in cases], "slots array<struct<id:string,severity:string>>, s map<string,double>")
    assert [r[0] for r in df.select(rewards.leakage_level(rewards.severity_exposure(F.col("slots"), F.col("s")))).collect()] == [w for _, w in cases]
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first().x
    assert val(rewards.utility_reward(F.lit(0.5), F.lit(0.335))) == pytest.approx(0.3196153846153846)
    assert val(rewards.utility_reward(F.lit(1.0), F.lit(0.33), 2.0)) == pytest.approx(0.34)
    assert val(rewards.decision_reward(F.lit(0.0), F.lit(0.0))) == -1.0 and val(rewards.decision_reward(F.lit(0.0), F.lit(1.0))) == -0.5
    assert val(rewards.decision_reward(F.lit(1.0), F.lit(0.0), 0.0)) == 1.0 and val(rewards.decision_reward(F.lit(0.0), F.lit(1.0), 1.0)) == 0.0
    assert val(rewards.final_decision_reward(F.lit(0.0), F.lit(0.0), F.lit(False), F.lit(False))) == -0.75
    assert val(rewards.final_decision_reward(F.lit(1.0), F.lit(1.0), F.lit(True), F.lit(True))) is None
    assert [val(rewards.nearest_level(F.lit(x))) for x in (0.1, 0.165, 0.5, 0.9)] == [0.0, 0.33, 0.67, 1.0]


def test_group_filters_and_breaker(spark):
    S = "g int, reward_value double, training_eligible boolean, reward_category string"
    rows = [(1, 0.5, True, "scored"), (1, 0.7, True, "scored"), (2, 0.5, True, "scored"), (2, 0.5, True, "scored"), (3, None, False, "judge_failure"), (3, 1.0, False, "scored"), (4, None, False, "judge_failure"), (4, None, None, "eil_evaluator_failure")]
    got = {r.g: r for r in rewards.group_verdicts(spark.createDataFrame(rows, S), "g").collect()}
    assert got[1].keep and not got[2].keep and got[2].reason == "zero_std_0.5"
    assert got[3].reason == "ineligible_judge_failure_1+scored_1" and not got[3].infra_failure
    assert got[4].infra_failure and got[4].reason == "ineligible_eil_evaluator_failure_1+judge_failure_1"
    rng = random.Random(6)
    flags = [rng.random() < 0.6 for _ in range(3000)]
    run, want = 0, []
    for f in flags:
        run = run + 1 if f else 0
        want.append(run)
    v = spark.createDataFrame(list(enumerate(flags)), "i int, infra_failure boolean")
    assert [r.consecutive_failures for r in rewards.breaker(v, "i", 3).orderBy("i").collect()] == want
    long = spark.createDataFrame([(i, i > 5) for i in range(4000)], "i int, infra_failure boolean")
    assert rewards.breaker(long, "i", 3).agg(F.max("consecutive_failures")).first()[0] == 3994


def test_statistics(spark):
    rng = random.Random(7)
    xs = [round(rng.random() * 5) for _ in range(41)]
    df = spark.createDataFrame([("a", x) for x in xs] + [("b", 1), ("c", None)], "g string, x int")
    ordered = sorted(xs)
    for q in (0.5, 0.95, 0.25):
        got = {r.g: r.value for r in stats.nearest_rank(df, "x", q, ["g"]).collect()}
        assert got == {"a": ordered[round(40 * q)], "b": 1}
    d = {r.g: r for r in stats.distribution(df, "x", ["g"]).collect()}
    n = Counter(xs)
    h = -sum(c / 41 * math.log(c / 41) for c in n.values())
    assert d["a"].effective_support == pytest.approx(math.exp(h), abs=1e-3) and d["b"].normalized_entropy == 1.0 and d["c"].support == 1
    assert stats.duplicate_excess(df.where("g = 'a'"), F.col("x")).first().excess == 41 - len(n)
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    for a in range(6):
        for k in (1, 2, 4):
            want = 1.0 if 5 - a < k else 1 - math.comb(5 - a, k) / math.comb(5, k)
            assert one(stats.pass_at_k(F.lit(5), F.lit(a), k)) == pytest.approx(want)
    assert stats.distribution(df.where("false"), "x").count() <= 1


def test_hashes(spark):
    import hashlib

    ids = ["", "a-1", "ü|x", "z" * 500]
    df = spark.createDataFrame([(i,) for i in ids], "i string")
    for r in df.select("i", hashing.seed64(F.col("i")).alias("s"), hashing.split_for("i").alias("p"), hashing.seed31(F.col("i")).alias("t")).collect():
        h = hashlib.sha256(r.i.encode()).hexdigest()
        b = int(h[:8], 16) % 100
        assert int(r.s) == int(h[:16], 16) and r.t == int(h[:8], 16) & 0x7FFFFFFF
        assert r.p == ("train" if b < 80 else "val" if b < 90 else "test")


def test_mapped_share(spark):
    df = spark.createDataFrame([("f", [["a", "b"], ["other"], ["a"]]), ("f", None), ("g", []), (None, [["other"]])], "f string, t array<array<string>>")
    got = {r.grp: (r.fields, r.unmapped, r.mapped_rate) for r in stats.mapped_share(df, "t", "f").collect()}
    assert got == {"(all)": (4, 2, 0.5), "f": (3, 1, 0.6667), "g": (0, 0, None), "(null)": (1, 1, 0.0)}


def test_materialised_tables_are_given_up(tmp_path):
    """forget and discard delete them, and so does the end of the driver; in a process of its own."""
    import os
    import subprocess
    import sys

    code = f"""
import os
from pyspark.sql import SparkSession
from rillstone import session
SparkSession.builder.config("spark.checkpoint.dir", {str(tmp_path)!r})
spark = session.local_session(1, 1, "512m")
one, two = (session.materialize(spark.range(3), n) for n in ("one", "two"))
session.discard(one)
left = os.listdir(session.own_folder(spark))
assert len(left) == 1 and left[0].startswith("two") and two.count() == 3
session.forget(spark)
assert not os.path.exists(session.own_folder(spark))
session.materialize(spark.range(3), "three")
assert os.listdir(session.own_folder(spark))
"""
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=True)
    assert os.listdir(tmp_path) == []
