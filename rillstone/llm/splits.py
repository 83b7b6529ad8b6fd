"""Problem 4: splits that keep records resting on a common source place together."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.flow import Network
from rillstone.llm.quotas import category_key
from rillstone.operators.graph import connected_components
from rillstone.operators.ranking import blocked_rank
from rillstone.operators.selection import with_position
from rillstone.session import materialize

#: Locators that name no place.
NO_PLACE = ("", "n/a", "unknown", "-")


def cited_places(sidecar: DataFrame) -> DataFrame:
    """(record_id, dataset, file, locator) of the facts of each record's highest attempt, distinct.

    The locator is lower-cased, stripped, with inner blanks made one; null, blank, n/a, unknown
    and - are no place, nor is one without dataset or file. A null attempt counts below all others.
    """
    facts = F.transform("source_packet.facts", lambda f: f["source_ref"])
    rows = sidecar.select("record_id", F.coalesce("attempt", F.lit(-1)).alias("attempt"), F.filter(facts, lambda r: r["locator"].isNotNull()).alias("refs")).where("record_id is not null")
    latest = rows.groupBy(F.col("record_id").alias("rid")).agg(F.max("attempt").alias("latest"))
    now = rows.join(latest, (F.col("record_id") == F.col("rid")) & (F.col("attempt") == F.col("latest"))).select("record_id", F.explode("refs").alias("r"))
    locator = F.trim(F.regexp_replace(F.lower("r.locator"), r"(?U)\s+", " "))
    return now.select("record_id", "r.dataset", "r.file", locator.alias("locator")).where(~F.col("locator").isin(*NO_PLACE) & F.col("dataset").isNotNull() & F.col("file").isNotNull()).distinct()


def record_groups(miu: DataFrame, sidecar: DataFrame) -> DataFrame:
    """(id, group_id): each MIU id with the smallest id of those tied to it, directly or through others.

    The records that cite a place are numbered in the order of their ids, so that ties and components
    work on whole numbers. Per place, one pre-aggregated minimum gives a star of ties; a place cited by
    a third of the records is joined like any skewed key. Records without a place are groups of their own.
    """
    ids = miu.select("id").where("id is not null").distinct()
    places = cited_places(sidecar).join(ids, F.col("record_id") == F.col("id"), "left_semi")
    places = materialize(places, "places")
    key = ["dataset", "file", "locator"]
    numbered = with_position(places.select("record_id").distinct(), ["record_id"], "n")
    cited = materialize(places.join(numbered, "record_id").select("n", *key), "cited")
    first = cited.groupBy(*key).agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    found = connected_components(cited.join(first, key).where("n != first").select(F.col("n").alias("src"), F.col("first").alias("dst")))
    name = lambda n, c: numbered.select(F.col("n").alias(n), F.col("record_id").alias(c))
    named = found.join(name("node", "own"), "node").join(name("component", "least"), "component").select("own", "least")
    return ids.join(named, F.col("id") == F.col("own"), "left").select("id", F.coalesce("least", "id").alias("group_id"))


def torn_groups(miu: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, group_id) of every record of a group that stands in two or more splits (trimmed, lower-cased, not null)."""
    split = miu.select("id", F.lower(F.trim("split")).alias("split")).where("split is not null").distinct()
    torn = groups.join(split, "id").groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select("group_id")
    return groups.join(torn, "group_id", "left_semi").select("id", "group_id")


@dataclass(frozen=True)
class NewSplits:
    """assigned: (id, group_id, family_domain, subscenario, new_split); groups: (id, group_id)."""

    assigned: DataFrame
    groups: DataFrame
    targets: DataFrame

    def mended(self, miu: DataFrame) -> DataFrame:
        """(id, group_id) of every record of a group that the present splits (trimmed, lower-cased, not null)
        tear apart and that now stands in one split."""
        now = self.assigned.groupBy("group_id").agg(F.min(F.xxhash64("new_split")).alias("a"), F.max(F.xxhash64("new_split")).alias("b")).where("a = b")
        return torn_groups(miu, self.assigned).join(now, "group_id", "left_semi").select("id", "group_id")

    def checks(self) -> DataFrame:
        """Per family with targets and split: (family_domain, split, family_rows, whole, near): no group in two splits,
        and the split's rows within the largest group's size of its share."""
        whole = self.assigned.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("new_split").alias("n"))
        # One row.
        worst = whole.agg(F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
        rows = self.report().join(self.assigned.groupBy("family_domain").agg(F.count(F.lit(1)).alias("family_rows")), "family_domain", "left")
        gap = F.abs(F.col("rows") - F.col("target_share") * F.coalesce("family_rows", F.lit(0)))
        return rows.join(F.broadcast(worst)).select("family_domain", "split", F.coalesce("family_rows", F.lit(0)).alias("family_rows"), (F.col("most") <= 1).alias("whole"), (gap <= F.greatest(F.col("largest"), F.lit(1))).alias("near"))

    def report(self) -> DataFrame:
        """Per family and split: target and real share, and the largest gap of a scenario's share to it."""
        t = self.targets
        whole = self.assigned.groupBy("family_domain").agg(F.count(F.lit(1)).alias("family_rows"))
        part = self.assigned.groupBy("family_domain", F.col("new_split").alias("split")).agg(F.count(F.lit(1)).alias("rows"))
        by_scenario = self.assigned.groupBy("family_domain", "subscenario").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("new_split") == s).alias(s) for s in ("train", "val", "test")])
        rows = t.join(whole, "family_domain", "left").join(part, ["family_domain", "split"], "left")
        gaps = by_scenario.select("family_domain", "n", F.explode(F.create_map(*[x for s in ("train", "val", "test") for x in (F.lit(s), F.col(s))])).alias("split", "k"))
        gaps = gaps.join(t, ["family_domain", "split"]).groupBy("family_domain", "split").agg(F.max(F.abs(F.col("k") - F.col("n") * F.col("share_pm") / 1000)).alias("widest_gap_rows"))
        real = F.coalesce(F.try_divide(F.coalesce("rows", F.lit(0)), "family_rows"), F.lit(0.0))
        return rows.join(gaps, ["family_domain", "split"], "left").select("family_domain", "split", (F.col("share_pm") / 1000).alias("target_share"), real.alias("actual_share"), F.coalesce("rows", F.lit(0)).alias("rows"), "widest_gap_rows")


def _solve(bundles: list, shares: dict[str, dict[str, int]], totals: dict | None = None, used: dict | None = None) -> list[tuple[str, str, int, int]]:
    """Whole numbers of groups per bundle and split: (bundle, split, lo, hi) as ranges of ranks.

    Bundles of one family and scenario differ in size alone and have the same arcs at the same cost,
    so the flow is solved on their sum and each takes its part of it; then each bundle is rounded to
    whole groups, the largest sizes first. The flow's size is that of the targets, whatever the
    number of sizes. totals: all rows of each family and scenario, by default the bundles' own; used:
    the rows that each of them already has in a split.
    """
    used = used or {}
    by_family: dict[str, list] = defaultdict(list)
    for b in bundles:
        by_family[b.family].append(b)
    ranges = []
    for family, own in sorted(by_family.items(), key=str):
        share = shares.get(family) or {"train": 1000}
        names = sorted(share)
        supply: dict = defaultdict(int)
        for b in own:
            supply[b.scenario] += b.rows
        rows = supply if totals is None else {s: n for (f, s), n in totals.items() if f == family}
        everything, per_mille = sum(rows.values()), sum(share.values()) or 1
        net, arcs = Network(), {}
        for t in names:
            quota = everything * share[t] // per_mille - sum(n for (f, _, u), n in used.items() if (f, u) == (family, t))
            net.arc(("family", t), "sink", max(0, quota))
            net.arc(("family", t), "sink", everything, 10)
            for s, n in rows.items():
                net.arc((s, t), ("family", t), max(0, -(-n * share[t] // per_mille) - used.get((family, s, t), 0)))
                net.arc((s, t), ("family", t), n, 1)
        for s, n in supply.items():
            net.arc("source", ("bundles", s), n)
            for t in names:
                arcs[s, t] = net.arc(("bundles", s), (s, t), n)
        net.solve("source", "sink")
        part = {(s, t): net.flow(a) / supply[s] for (s, t), a in arcs.items()}
        carry: dict = defaultdict(float)
        for b in sorted(own, key=lambda b: (-b.size, b.bundle)):
            wish = {t: part[b.scenario, t] * b.groups + carry[b.scenario, t] / b.size for t in names}
            count = {t: max(0, int(wish[t] // 1)) for t in names}
            while (over := sum(count.values()) - b.groups) > 0:
                worst = max((t for t in names if count[t]), key=lambda t: (count[t] - wish[t], t))
                count[worst] -= min(over, count[worst])
            while sum(count.values()) < b.groups:
                best = max(names, key=lambda t: (wish[t] - count[t], t))
                count[best] += 1
            at = 0
            for t in names:
                carry[b.scenario, t] = (wish[t] - count[t]) * b.size
                if count[t]:
                    ranges.append((b.bundle, t, at, at + count[t]))
                    at += count[t]
    return ranges


def assign_splits(miu: DataFrame, sidecar: DataFrame, targets: DataFrame, seed: int = 41) -> NewSplits:
    """Assign records to splits in the target shares per family, whole groups at a time.

    A group's label is its commonest family and scenario, its size the number of its ids. Groups
    of one size and label form a bundle; a flow sends each bundle's rows to the splits within the
    scenario's and family's quotas, at a price for exceeding them; the flows are rounded to whole
    groups from the largest groups down, passing each remainder on; and the groups of a bundle are
    taken in a hashed order. Single records come last, in a second flow over what the larger groups,
    counted record by record, have left of each quota. Null and unlisted families go to train.
    Repeated rows count once; targets without a split are left out; an empty table gives empty results. The driver holds one row per
    bundle: labels times distinct sizes, of which n records have at most sqrt(2 n) per label.
    """
    spark = miu.sparkSession
    groups = materialize(record_groups(miu, sidecar), "record-groups")
    labels = miu.where("id is not null").groupBy("id").agg(*[F.max(category_key(F.col(c))).alias(c) for c in ("family_domain", "subscenario")])
    rows = groups.join(labels, "id")
    votes = rows.groupBy("group_id", "family_domain", "subscenario").agg(F.count(F.lit(1)).alias("n"))
    named = votes.groupBy("group_id").agg(F.sum("n").alias("size"), F.max_by(F.struct("family_domain", "subscenario"), F.struct("n", "family_domain", "subscenario")).alias("label"))
    named = materialize(named.select("group_id", "size", F.col("label.family_domain").alias("family"), F.col("label.subscenario").alias("scenario")), "labelled-groups")
    chosen = named.withColumn("bundle", F.concat_ws("|", F.coalesce("family", F.lit("\u0001")), F.coalesce("scenario", F.lit("\u0001")), F.col("size").cast("string")))
    shares: dict[str, dict[str, int]] = defaultdict(dict)
    targets = targets.where("split is not null")
    for r in targets.select(category_key(F.col("family_domain")).alias("f"), F.lower(F.trim("split")).alias("s"), "share_pm").collect():
        shares[r.f][r.s] = r.share_pm or 0
    # One row per bundle (labels times sizes), one total per label.
    bundles = chosen.groupBy("bundle", "family", "scenario", "size").agg(F.count(F.lit(1)).alias("groups"), F.sum("size").alias("rows")).collect()
    ranked = materialize(blocked_rank(chosen.select("group_id", "bundle"), ["bundle"], ["group_id"], seed, "r"), "ranked-groups")

    def placed(ranges: list[tuple[str, str, int, int]]) -> DataFrame:
        table = spark.createDataFrame(ranges, "bundle string, new_split string, lo long, hi long")
        return ranked.join(table, "bundle").where("r >= lo and r < hi").select("group_id", "new_split")

    large = materialize(placed(_solve([b for b in bundles if b.size > 1], shares)), "placed-groups")
    per_label = lambda df, *more: df.groupBy("family_domain", "subscenario", *more).agg(F.count(F.lit(1)).alias("n")).collect()
    totals = {(r.family_domain, r.subscenario): r.n for r in per_label(rows)}
    used = {(r.family_domain, r.subscenario, r.new_split): r.n for r in per_label(rows.join(large, "group_id"), "new_split")}
    small = placed(_solve([b for b in bundles if b.size == 1], shares, totals, used))
    assigned = rows.join(large.unionAll(small), "group_id").select("id", "group_id", "family_domain", "subscenario", "new_split")
    named_targets = targets.select(category_key(F.col("family_domain")).alias("family_domain"), F.lower(F.trim("split")).alias("split"), "share_pm")
    return NewSplits(assigned, groups, named_targets)
