"""Problem 1: a sample whose category shares match targets, by min-cost flow on cell counts."""

from __future__ import annotations

import random
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rillstone.llm.flow import Network, round_quotas
from rillstone.operators.ranking import blocked_rank
from rillstone.session import materialize

CATEGORIES = ("mechanism", "family_domain", "subscenario")
#: Micro-rows: targets are shares per mille of draws per mille of the pool, so whole at this scale.
UNIT = 1_000_000
FLOOR_SLACK, TARGET_SLACK = 1000, 10


def category_key(c: str | Column) -> Column:
    """Lower case, runs of other characters than a-z0-9 as one _, no _ outside; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")


def record_pool(*tables: DataFrame) -> DataFrame:
    """Each id once with its category keys. Of differing rows of one id the greatest keys count, so
    that a null never hides a known category; rows without an id are left out."""
    rows = [t.select("id", *[category_key(F.col(c)).alias(c) for c in CATEGORIES]).where("id is not null") for t in tables]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionAll(r)
    return both.groupBy("id").agg(*[F.max(c).alias(c) for c in CATEGORIES])


@dataclass(frozen=True)
class CategorySample:
    """report: one row per cell; sample: (plan_id, cell_id, id)."""

    report: DataFrame
    sample: DataFrame

    def margins(self) -> DataFrame:
        """Per cell, what the drawn records themselves show: (plan_id, cell_id, available, short_rows, cannot_meet,
        met); met: within one row of what was wanted and not short."""
        got = self.sample.groupBy("plan_id", "cell_id").agg(F.count(F.lit(1)).alias("in_cell"), F.count_distinct("id").alias("ids"))
        rows = self.report.join(got, ["plan_id", "cell_id"], "left").withColumn("in_cell", F.coalesce("in_cell", F.lit(0)))
        gap = F.abs(F.col("in_cell") - (F.greatest("target_rows", "min_rows") - F.col("short_rows")))
        met = (gap < 1) & (F.col("in_cell") == F.coalesce("ids", F.lit(0)))
        return rows.select("plan_id", "cell_id", "available", F.round("short_rows", 6).alias("short_rows"), "cannot_meet", met.alias("met"))


def _kinds(pool: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Category triples with the cells they are in, per plan, and how many records each kind has.

    A kind is a plan with a set of its cells. Each triple meets the cells over its eight
    generalisations (a category or null), by equality.
    """
    counts = pool.groupBy(*CATEGORIES).agg(F.count(F.lit(1)).alias("n"))
    cells = targets.select("plan_id", "cell_id", *[category_key(F.col(c)).alias(f"want_{c}") for c in CATEGORIES])
    general = [F.struct(*[(F.col(c) if bits >> i & 1 else F.lit(None).cast("string")).alias(f"as_{c}") for i, c in enumerate(CATEGORIES)]) for bits in range(8)]
    wide = counts.select(*CATEGORIES, "n", F.explode(F.array_distinct(F.array(*general))).alias("g")).select(*CATEGORIES, "n", "g.*")
    same = [F.col(f"as_{c}").eqNullSafe(F.col(f"want_{c}")) for c in CATEGORIES]
    held = wide.join(cells, same[0] & same[1] & same[2]).groupBy("plan_id", *CATEGORIES).agg(F.sort_array(F.collect_set("cell_id")).alias("cells"), F.first("n").alias("n"))
    return held, held.groupBy("plan_id", "cells").agg(F.sum("n").alias("n"))


def _entangled(kinds: list[tuple[tuple[int, ...], int]]) -> list[list[tuple[tuple[int, ...], int]]]:
    """The kinds in lots that share no cell with each other."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        root.setdefault(c, c)
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for kind, _ in kinds:
        for c in kind[1:]:
            root[find(c)] = find(kind[0])
    lots = defaultdict(list)
    for kind, n in kinds:
        lots[find(kind[0])].append((kind, n))
    return list(lots.values())


def _demands(cell: Row, total: int) -> tuple[int, int]:
    """Micro-rows that the floor asks for, and those that the share asks for beyond it."""
    floor = cell.min_rows * UNIT
    return floor, max(0, cell.share_pm * cell.draw_pm * total - floor)


def _filled(cells: dict[int, Row], kinds: list[tuple[tuple[int, ...], int]], total: int) -> tuple[dict, dict[int, int]]:
    """The cheapest flow from kinds to cells, in micro-rows: ({(kind, cell): flow}, {cell: what its slack arcs carry})."""
    net, arcs, slack = Network(), defaultdict(list), defaultdict(list)
    for cell, c in cells.items():
        for part, demand, price in zip(("floor", "share"), _demands(c, total), (FLOOR_SLACK, TARGET_SLACK)):
            net.arc((part, cell), "sink", demand)
            slack[cell].append(net.arc("source", (part, cell), demand, price))
    for kind, n in kinds:
        net.arc("source", ("kind", kind), n * UNIT)
        for cell in kind:
            for part, demand in zip(("floor", "share"), _demands(cells[cell], total)):
                if demand:
                    arcs[kind, cell].append(net.arc(("kind", kind), (part, cell), demand))
    net.solve("source", "sink")
    return {k: sum(map(net.flow, own)) for k, own in arcs.items()}, {c: sum(map(net.flow, own)) for c, own in slack.items()}


def sample_by_targets(pool: DataFrame, targets: DataFrame, seed: int = 97) -> CategorySample:
    """Draw per plan a sample with the target shares, and report the cells that fall short.

    pool: (id, mechanism, family_domain, subscenario) as from record_pool; targets: plan_id,
    cell_id, the three categories (null = any), share_pm, min_rows, draw_pm. A cell wants the
    larger of its share of the draw and min_rows; a flow fills it from the kinds of records it
    holds, at a higher price for missing a floor than for missing a share, and what the slack
    arcs carry is the shortfall (short_rows). A cell cannot be met (cannot_meet) where its slack
    carries something even in a flow in which no other cell competes for its records. Lots of
    cells that share no record are solved apart. Fractional quotas become whole at random,
    keeping every sum between its floor and ceiling; records are taken in a hashed order within
    their kind, each at most once per plan. A null category of a record equals nothing. An empty
    pool leaves every cell with a positive demand short. A cell with null numbers demands
    nothing; a target without a cell_id is left out. The driver holds the plans' cells and one count per distinct set of cells, never a
    record.
    """
    spark, targets = pool.sparkSession, targets.where("cell_id is not null")
    pool = materialize(pool, "pool")
    held, kinds = _kinds(pool, targets)
    held = materialize(held, "kinds")
    total = pool.count()
    got = kinds.collect()
    cells = targets.select("plan_id", "cell_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("share_pm", "min_rows", "draw_pm")]).distinct().collect()
    by_plan: dict[str, dict[int, Row]] = defaultdict(dict)
    for c in cells:
        by_plan[c.plan_id][c.cell_id] = c
    kinds_of = defaultdict(list)
    for k in got:
        kinds_of[k.plan_id].append((tuple(k.cells), k.n))
    report, ranges = [], []
    for plan in sorted(by_plan, key=str):
        own, of_plan = by_plan[plan], sorted(kinds_of[plan])
        holds = defaultdict(list)
        for kind, n in of_plan:
            for cell in kind:
                holds[cell].append(n)
        rng, short, drawn = random.Random(f"{seed}:{plan}"), {}, defaultdict(int)
        for lot in _entangled(of_plan):
            inside = {c: own[c] for kind, _ in lot for c in kind}
            flow, missing = _filled(inside, lot, total)
            short |= missing
            whole = round_quotas(flow, UNIT, rng)
            for kind, _ in lot:
                at = 0
                for cell in kind:
                    if n := whole.get((kind, cell), 0):
                        ranges.append((plan, list(kind), cell, at, at + n))
                        at += n
                        drawn[cell] += n
        size = sum(drawn.values())
        for cell, c in sorted(own.items()):
            alone = _filled({cell: c}, [((cell,), sum(holds[cell]))], total)[1][cell]
            target = c.share_pm * c.draw_pm * total
            report.append((plan, cell, c.share_pm / 1000, target / UNIT, c.min_rows, sum(holds[cell]), drawn[cell], drawn[cell] / size if size else 0.0, short.get(cell, alone) / UNIT, alone > 0))
    rows = spark.createDataFrame(report, "plan_id string, cell_id int, target_share double, target_rows double, min_rows long, available long, drawn long, actual_share double, short_rows double, cannot_meet boolean")
    quota = spark.createDataFrame(ranges, "plan_id string, cells array<int>, cell_id int, lo long, hi long")
    same = [pool[c].eqNullSafe(held[c]) for c in CATEGORIES]
    placed = pool.join(held, same[0] & same[1] & same[2]).select("plan_id", "cells", "id")
    ranked = blocked_rank(placed, ["plan_id", "cells"], ["id"], seed, "r", sum(k.n for k in got))
    sample = ranked.join(quota, ["plan_id", "cells"]).where("r >= lo and r < hi").select("plan_id", "cell_id", "id")
    return CategorySample(rows, sample)
