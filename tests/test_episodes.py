"""Attempts, fills, repeats, grids and projections on small written cases."""

import pytest
from pyspark.sql import functions as F

from rillstone.functions import sequences
from rillstone.operators import episodes, merging, rewards


def test_attempts_fills_and_repeats(spark):
    a = spark.createDataFrame([("x", 1, False), ("x", 2, True), ("x", 3, True), ("y", 1, False), ("y", 2, None)], "k string, attempt int, ok boolean")
    got = {r.k: (r.attempt, r.attempts, r.repaired) for r in episodes.first_valid_attempt(a, ["k"], "attempt", F.coalesce("ok", F.lit(False))).collect()}
    assert got == {"x": (2, 3, True), "y": (2, 2, False)}
    v = spark.createDataFrame([(i, i % 3 != 0, "flat" if i % 2 else "bad") for i in range(20)], "g int, keep boolean, reason string")
    assert [r.g for r in episodes.filled(v, "g", 4).orderBy("g").collect()] == [1, 2, 4, 5]
    assert {r.reason: r.groups for r in episodes.fill_report(v, "g", 4).collect()} == {"bad": 1, "flat": 1}
    first, rest = episodes.popped(v, ["g"], 5)
    assert first.count() == 5 and rest.agg(F.min("g")).first()[0] == 5
    p, d = spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "k string")
    assert {tuple(r) for r in episodes.remaining_repeats(p, d, "k", 2).collect()} == {("b", 2), ("c", 1), ("c", 2)}
    s = spark.createDataFrame([("q", 1.0), ("q", -0.5), ("r", -1.0), ("s", None)], "q string, r double")
    assert [r.q for r in episodes.solved(s, "q", "r").collect()] == ["q"]


def test_consensus_grids_and_deltas(spark):
    f = lambda *rows: spark.createDataFrame(list(rows), "id int, label string")
    got = episodes.consensus(f((1, "a"), (2, "b"), (3, "c")), f((1, "a"), (2, "b"), (3, "d")), "id", "label", f((1, "a"), (2, "x"), (3, "c"), (4, "q"))).collect()
    assert {r.id: r.outcome for r in got} == {1: "accepted", 2: "changed", 3: "disagree", 4: "missing"}
    assert episodes.grid(spark.range(3), adversary=["m", "n"], temperature=[0.3, 0.6, 1.0]).count() == 18
    before, after = spark.createDataFrame([("s", 1, 2.0, True)], "k string, a int, b double, c boolean"), spark.createDataFrame([("s", 4, None, False)], "k string, a int, b double, c boolean")
    assert [tuple(r) for r in episodes.numeric_deltas(before, after, "k").collect()] == [("s", "a", 3.0)]
    m = spark.createDataFrame([([1.0, 3.0, 9.0], [1, 1, 0]), ([6.0], [1]), ([5.0], [0])], "v array<double>, m array<int>")
    r = episodes.mean_kinds(m, "v", "m").first()
    assert r.mean_of_means == pytest.approx(8 / 3) and r.token_mean == pytest.approx(10 / 3)
    assert episodes.ranges(spark.createDataFrame([("g", 1.0), ("g", 4.0)], "g string, x double"), ["g"], ["x"]).first().x_range == 3.0


def test_projections(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    L = F.lit
    x = one(episodes.shuffled_choices(L("k"), F.array(L("a"), L("b"), L("c")), L("b"), 5))
    assert sorted(x.choices) == ["a", "b", "c"] and x.choices["ABC".index(x.letter)] == "b"
    assert one(episodes.shuffled_choices(L("k"), F.array(L("a")), L("z"), 5)).letter is None
    maps = [F.create_map(L("a"), L("1"), L("b"), L("2")), L(None).cast("map<string,string>"), F.create_map(L("b"), L("3"))]
    assert one(episodes.merged_metadata(*maps)) == {"a": "1", "b": "3"}
    assert one(episodes.recovered_slots(F.create_map(L("s2"), L(0.3), L("s1"), L(1.0), L("s3"), L(0.0)))) == ["s1", "s2"]
    for t, want in (("Answer: \\boxed{4}", ("answer", "4")), ("<tool_call> {} </tool_call>", ("tool", "{}")), ("```py\nx\n```", ("code", "x"))):
        assert tuple(one(episodes.tool_call(L(t)))) == want
    assert one(episodes.tool_call(L("nothing"))) is None
    assert one(episodes.cut_after_call(L("a </search> b </answer>"))) == "a </search>" and one(episodes.cut_after_call(L("plain"))) == "plain"
    assert episodes.json_objects('<think>{"a": 0}</think> x {"a": 1, "b": {"a": 2}} {"a": 3} {bad', ("a",)) == [{"a": 3}]
    df = spark.createDataFrame([("f1", "red fox", "red dog", 0.5), ("boxed_em", "so \\boxed{Fox}", "fox", 1.0), ("letter", "the answer is B", "B", 1.0), ("math", "\\boxed{1/2}", "0.5", 1.0), ("none", "x", "x", None)], "k string, r string, t string, want double")
    assert all(r.got == r.want for r in df.select("want", episodes.graded("k", "r", "t").alias("got")).collect())
    assert episodes.load_callable("math.sqrt")(4) == 2.0
    with pytest.raises(ValueError):
        episodes.load_callable("nothing")


def test_buffer_first_carry_over_and_checker(spark):
    b, d = spark.createDataFrame([(5,), (6,)], "g int"), spark.createDataFrame([(1,), (2,), (3,)], "g int")
    keys = lambda df: sorted(r.g for r in df.collect())
    assert [keys(x) for x in episodes.buffered_first(b, d, ["g"], 3)] == [[1, 5, 6], [], [2, 3]]
    assert [keys(x) for x in episodes.buffered_first(b, d, ["g"], 1)] == [[5], [6], [1, 2, 3]]
    s = spark.createDataFrame([(1, 0, "aborted", "ab", None), (1, 1, "completed", "c", 3), (1, 2, "aborted", "", None), (2, 3, "completed", "d", None)], "g int, i int, status string, response string, start_rollout_id int")
    assert {r.i: r.start_rollout_id for r in episodes.carried_over(s, "g", 7).collect()} == {0: 7, 1: 3, 2: None}
    check = lambda *v: tuple(episodes.metric_reached(spark.createDataFrame([(x,) for x in v], "m double"), "m", 0.5).first())
    assert check(0.1, 0.5) == (2, 0, True) and check(0.1) == (1, 0, False) and check(0.9, None) == (2, 1, False) and check() == (0, 0, False)
    t = lambda *v: spark.createDataFrame([(x,) for x in v], "tactic string")
    assert [r.tactic for r in merging.heldout(t("a", "b", "b", None), t("a", "c", None), "tactic").collect()] == ["b"]


def test_tool_and_agent_rewards(spark):
    df = spark.createDataFrame([(1.0, 9), (-1.0, 2), (-1.0, 6), (-1.0, 40), (-1.0, None)], "s double, n int")
    assert [round(r.x, 6) for r in df.select(rewards.tool_use_reward(F.col("s"), F.col("n")).alias("x")).collect()] == [1.0, -1.0, -0.8, -0.6, -1.1]
    g = spark.createDataFrame([("a", "solver", 0.0), ("a", "rewriter", 1.0), ("a", "selector", 1.0), ("b", "solver", 1.0), ("b", "selector", 0.0), ("c", "solver", 1.0), (None, "solver", 1.0)], "g string, role string, r double")
    got = sorted((str(r.g), r.role, round(r.r, 6)) for r in rewards.multi_agent_rewards(g, "g", "role", "r", 1.2, 0.8).collect())
    assert got == [("None", "solver", 0.8), ("a", "rewriter", 1.2), ("a", "selector", 1.2), ("a", "solver", 0.0), ("b", "selector", 0.0), ("b", "solver", 0.8), ("c", "solver", 0.8)]


def test_advantage_dispatcher(spark):
    df = spark.createDataFrame([(2.0, [-1.0, -2.0], [-1.5, -1.0], [1, 1], [0.5, 0.25], [-9.0, -0.5, -0.5])], "r double, lp array<double>, ref array<double>, m array<int>, v array<double>, t array<double>")
    c = F.col
    run = lambda name, **x: tuple([round(y, 6) for y in z] for z in df.select(sequences.advantages(name, c("r"), c("lp"), c("ref"), c("m"), c("v"), c("t"), **x).alias("a")).first().a)
    assert run("grpo") == run("gspo") == ([2.0, 2.0], [2.0, 2.0])
    assert run("ppo", kl_coef=0.1, gamma=0.9, lam=0.8) == ([1.007, 1.85], [1.507, 2.1])
    assert run("reinforce_plus_plus", kl_coef=0.1, gamma=0.5) == ([1.0, 2.1], [1.0, 2.1])
    assert run("reinforce_plus_plus_baseline", kl_coef=0.1) == ([1.95, 2.1], [1.95, 2.1])
    assert run("on_policy_distillation", kl_coef=0.1) == ([0.5, 1.5], [0.5, 1.5])
    with pytest.raises(ValueError):
        run("other")
    with pytest.raises(ValueError):
        sequences.advantages("ppo", c("r"), c("lp"))
