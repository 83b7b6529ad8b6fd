"""Samples by category targets and splits of tied records, against brute force and by invariants."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row

from rillstone.llm.flow import Network, round_quotas
from rillstone.llm.quotas import record_pool, sample_by_targets
from rillstone.llm.splits import assign_splits, record_groups, torn_groups

TARGET = "plan_id string, cell_id int, mechanism string, family_domain string, subscenario string, share_pm int, min_rows int, draw_pm int"
RECORD = "id string, mechanism string, family_domain string, subscenario string, n string"


def key(s):
    return None if s is None else re.sub(r"[^a-z0-9]+", "_", s.lower()).strip("_")


@pytest.fixture(scope="module")
def pool_rows():
    rng = random.Random(5)
    rows = []
    for i in range(900):
        m, f, s = rng.choice([("MIU", "fin ance", "Bond-Ladder"), ("miu ", "Fin_Ance", "index  fund"), ("EIL", "redress", "hail claim"), ("EIL", None, "hail claim"), (None, "redress", None)])
        rows.append((f"r{i:04d}", m, f, s, "clash"))
    return rows + [("rare", "MIU", "misc", "one", ""), rows[0], (None, "MIU", "misc", "one", "")]


CELLS = [("p", 1, "MIU", None, None, 300, 5, 500), ("p", 2, "EIL", "redress", None, 200, 5, 500), ("p", 3, "MIU", "misc", "one", 100, 2, 500), ("p", 4, None, "FIN ANCE", "bond ladder", 400, 1, 500), ("q", 5, "nobody", None, None, 1000, 1, 100), ("z", 6, "EIL", None, None, None, 3, None)]


def test_sample_matches_brute_force_and_quotas(spark, pool_rows):
    pool = record_pool(spark.createDataFrame(pool_rows, RECORD))
    out = sample_by_targets(pool, spark.createDataFrame([*CELLS, CELLS[0], ("p", None, "MIU", None, None, 10, 1, 10), (None, 9, None, None, None, None, None, None)], TARGET))
    own = {i: tuple(map(key, c)) for i, *c, _ in pool_rows if i}
    inside = {c[1]: {i for i, k in own.items() if all(w is None or key(w) == v for w, v in zip(c[2:5], k))} for c in CELLS}
    report = {r.cell_id: r for r in out.report.where("plan_id is not null").collect()}
    for c in CELLS:
        short = len(inside[c[1]]) * 1_000_000 < (c[5] or 0) * (c[7] or 0) * len(own) or len(inside[c[1]]) < (c[6] or 0)
        assert report[c[1]].available == len(inside[c[1]]) and report[c[1]].cannot_meet == short, c
    got = defaultdict(list)
    for r in out.sample.collect():
        assert r.id in inside[r.cell_id]
        got[r.plan_id].append(r.id)
    assert all(len(v) == len(set(v)) for v in got.values())
    sizes = Counter(r.cell_id for r in out.sample.collect())
    for c, r in report.items():
        assert sizes[c] == r.drawn and abs(r.drawn - (max(r.target_rows, r.min_rows) - r.short_rows)) < 1
    assert report[6].drawn == 3


def test_many_kinds_and_competing_cells(spark):
    """No limit on kinds: 60,000 disjoint cells at once, and cells that compete for the same records."""
    from rillstone.llm.quotas import UNIT, _entangled, _filled

    cells = {i: Row(share_pm=0, draw_pm=0, min_rows=3) for i in range(60_000)}
    kinds = [((i,), 1 + i % 4) for i in cells]
    lots = _entangled(kinds)
    short = {c: m for lot in lots for c, m in _filled({c: cells[c] for k, _ in lot for c in k}, lot, 10)[1].items()}
    assert len(lots) == 60_000 and all(short[i] == max(0, 2 - i % 4) * UNIT for i in cells)
    two = {1: Row(share_pm=500, draw_pm=1000, min_rows=0), 2: Row(share_pm=500, draw_pm=1000, min_rows=4)}
    flow, missing = _filled(two, [((1,), 2), ((1, 2), 4)], 10)
    assert missing == {1: 3 * UNIT, 2: 1 * UNIT} and sum(flow.values()) == 6 * UNIT
    assert _filled({1: two[1]}, [((1,), 6)], 10)[1][1] == 0


def test_margins_of_the_drawn_records(spark, pool_rows):
    pool = record_pool(spark.createDataFrame(pool_rows, RECORD))
    rows = sample_by_targets(pool, spark.createDataFrame(CELLS, TARGET)).margins().collect()
    assert len(rows) == len(CELLS) and all(r.met for r in rows)


def test_empty_pool(spark):
    out = sample_by_targets(record_pool(spark.createDataFrame([], RECORD)), spark.createDataFrame(CELLS, TARGET))
    assert {r.cell_id for r in out.report.where("cannot_meet").collect()} == {1, 2, 3, 4, 5, 6}
    assert out.sample.count() == 0


def test_flow_is_cheapest():
    rng = random.Random(3)
    for _ in range(25):  # against exhaustive assignment of 2 sources to 3 sinks
        supply, demand = [rng.randint(0, 4) for _ in range(2)], [rng.randint(0, 4) for _ in range(3)]
        cost = [[rng.randint(0, 9) for _ in range(3)] for _ in range(2)]
        net = Network()
        for i, n in enumerate(supply):
            net.arc("s", ("a", i), n)
        for j, n in enumerate(demand):
            net.arc(("b", j), "t", n)
        for i in range(2):
            for j in range(3):
                net.arc(("a", i), ("b", j), 99, cost[i][j])
        flow, spent = net.solve("s", "t")
        ranges = [range(min(supply[i], demand[j]) + 1) for i in range(2) for j in range(3)]
        best = None
        import itertools

        for x in itertools.product(*ranges):
            if all(sum(x[i * 3 : i * 3 + 3]) <= supply[i] for i in range(2)) and all(x[j] + x[3 + j] <= demand[j] for j in range(3)):
                c = (-sum(x), sum(x[i * 3 + j] * cost[i][j] for i in range(2) for j in range(3)))
                best = min(best, c) if best else c
        assert (-flow, spent) == best


def test_rounding_keeps_sums_and_expectations():
    x = {("a", 1): 1500, ("a", 2): 700, ("b", 1): 250, ("b", 2): 800, ("c", 2): 3000}
    seen = Counter()
    for seed in range(400):
        w = round_quotas(dict(x), 1000, random.Random(seed))
        for side in (0, 1):
            for name in {k[side] for k in x}:
                total = sum(v for k, v in x.items() if k[side] == name)
                assert total // 1000 <= sum(v for k, v in w.items() if k[side] == name) <= -(-total // 1000)
        assert all(v // 1000 <= w[k] <= -(-v // 1000) for k, v in x.items())
        seen.update(w)
    assert all(abs(seen[k] / 400 - v / 1000) < 0.1 for k, v in x.items())


REF = "record_id string, attempt int, source_packet struct<facts:array<struct<source_ref:struct<dataset:string,file:string,locator:string>>>>, id string"
MIU = "id string, split string, family_domain string, subscenario string, node string"


def tied():
    rng = random.Random(6)
    miu = [(f"m{i:03d}", rng.choice(["train", " Train", "val", "TEST", None]), rng.choice(["Fin", "com merce", None]), rng.choice(["a", "b", "c"]), "clash") for i in range(300)]
    side = []
    for i in range(300):
        for attempt in (1, rng.choice([1, 2])):
            refs = [Row(source_ref=Row(dataset="d", file="f", locator=rng.choice([f"Row  {rng.randrange(400)}", f" row {rng.randrange(400)}\t", "N/A", "-", "", None, "unknown"]))) for _ in range(2)]
            side.append((f"m{i:03d}", attempt, Row(facts=refs), "x"))
    side += [("e1", 1, Row(facts=[Row(source_ref=Row(dataset="d", file="f", locator="row 1"))]), ""), ("m000", None, None, ""), ("m001", 1, Row(facts=None), ""), (None, 1, None, "")]
    return miu, side


def components(miu, side):
    ids = {r[0] for r in miu}
    best = defaultdict(lambda: -1)
    for r in side:
        best[r[0]] = max(best[r[0]], -1 if r[1] is None else r[1])
    places = defaultdict(set)
    for r in side:
        if r[0] in ids and (-1 if r[1] is None else r[1]) == best[r[0]] and r[2] and r[2].facts:
            for f in r[2].facts:
                loc = " ".join((f.source_ref.locator or "").lower().split())
                if loc not in ("", "n/a", "unknown", "-"):
                    places[loc].add(r[0])
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for p in places.values():
        first, *rest = sorted(p)
        for b in rest:
            x, y = sorted((find(first), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_groups_and_torn_groups(spark):
    miu, side = tied()
    a, b = spark.createDataFrame(miu + miu[:4], MIU), spark.createDataFrame(side + side[:6], REF)
    want = components(miu, side)
    groups = record_groups(a, b)
    assert {r.id: r.group_id for r in groups.collect()} == want and groups.count() == len(want)
    splits = defaultdict(set)
    for i, s, *_ in miu:
        if s:
            splits[want[i]].add(s.strip().lower())
    assert {tuple(r) for r in torn_groups(a, groups).collect()} == {(i, g) for i, g in want.items() if len(splits[g]) > 1}


def test_new_splits_keep_groups_and_shares(spark):
    miu, side = tied()
    targets = spark.createDataFrame([(f, s, n) for f in ("fin", "Com Merce") for s, n in (("train", 800), ("val", 100), ("test", 100))] + [("fin", None, 7)], "family_domain string, split string, share_pm int")
    new = assign_splits(spark.createDataFrame(miu, MIU), spark.createDataFrame(side, REF), targets)
    rows = new.assigned.collect()
    assert len(rows) == 300 and len({r.id for r in rows}) == 300
    assert all(len({r.new_split for r in rows if r.group_id == g}) == 1 for g in {r.group_id for r in rows})
    for f in ("fin", "com_merce"):
        own = [r for r in rows if r.family_domain == f]
        assert abs(sum(r.new_split == "train" for r in own) / len(own) - 0.8) < 0.08
    assert len(new.report().collect()) == 6 and all(r.whole for r in new.checks().collect())
    present = defaultdict(set)
    for r in miu:
        if r[1]:
            present[r[0]].add(r[1].strip().lower())
    group = {r.id: r.group_id for r in rows}
    stands = defaultdict(set)
    for i, s in present.items():
        stands[group[i]] |= s
    assert {tuple(r) for r in new.mended(spark.createDataFrame(miu, MIU)).collect()} == {(i, g) for i, g in group.items() if len(stands[g]) > 1}


def test_every_size_is_a_bundle_of_its_own():
    """4000 sizes of one label, more than any table of bundles was once allowed to hold."""
    from rillstone.llm.splits import _solve

    bundles = [Row(bundle=f"f|s|{n}", family="f", scenario="s", size=n, groups=1 + n % 3, rows=n * (1 + n % 3)) for n in range(1, 4001)]
    total = sum(b.rows for b in bundles)
    ranges = _solve(bundles, {"f": {"train": 800, "val": 100, "test": 100}})
    size, got, seen = {b.bundle: b.size for b in bundles}, Counter(), Counter()
    for b, t, lo, hi in ranges:
        got[t] += (hi - lo) * size[b]
        seen[b] += hi - lo
    assert seen == {b.bundle: b.groups for b in bundles}
    assert all(abs(got[t] - total * w) <= 4000 for t, w in (("train", 0.8), ("val", 0.1), ("test", 0.1)))


def test_no_records(spark):
    a, b = spark.createDataFrame([], MIU), spark.createDataFrame([], REF)
    targets = spark.createDataFrame([], "family_domain string, split string, share_pm int")
    assert record_groups(a, b).count() == 0 and assign_splits(a, b, targets).assigned.count() == 0
