"""Rewards from judge outputs, group normalisation, and group filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions.taxonomies import INFRASTRUCTURE_FAILURES, SEVERITY_WEIGHTS
from rillstone.operators.selection import with_position

LAMBDA = 0.35 / 0.65
BREAKER_ROWS = 1 << 16


def severity_exposure(slots: Column, scores: Column) -> Column:
    """Severity-weighted exposure of slots: sum of w * clip(score) over sum of w, at least 1; a slot without a score has 0."""
    weight = lambda s: F.coalesce(F.element_at(F.create_map(*[x for k, v in SEVERITY_WEIGHTS.items() for x in (F.lit(k), F.lit(float(v)))]), s["severity"]), F.lit(0.0))
    score = lambda s: F.least(F.greatest(F.coalesce(F.try_element_at(scores, s["id"]), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    total = F.aggregate(slots, F.lit(0.0), lambda a, s: a + weight(s))
    got = F.aggregate(slots, F.lit(0.0), lambda a, s: a + weight(s) * score(s))
    return got / F.greatest(total, F.lit(1.0))


def leakage_level(exposure: Column) -> Column:
    """Four levels: 0, 0.33, 0.67 above 0.33, 1 above 0.67."""
    return F.when(exposure == 0, 0.0).when(exposure > 0.67, 1.0).when(exposure > 0.33, 0.67).when(exposure.isNotNull(), 0.33)


def nearest_level(value: Column) -> Column:
    """The judge level nearest to an ensemble mean, ties upward."""
    return F.when(value < 0.165, 0.0).when(value < 0.5, 0.33).when(value < 0.835, 0.67).when(value.isNotNull(), 1.0)


def utility_reward(utility: Column, leakage: Column, lam: float = LAMBDA) -> Column:
    return utility - F.lit(lam) * leakage


def decision_reward(match: Column, faithfulness: Column, eta: float = 0.5) -> Column:
    return F.lit(-1.0) + F.lit(2.0 - eta) * match + F.lit(eta) * faithfulness


def final_decision_reward(match: Column, faithfulness: Column, valid: Column, scorer_failed: Column, eta: float = 0.5) -> Column:
    """Null where a scorer failed, -0.75 where the response broke the protocol, else the reward."""
    return F.when(~valid, F.lit(-0.75)).when(scorer_failed, F.lit(None).cast("double")).otherwise(decision_reward(match, faithfulness, eta))


def tool_use_reward(score: Column, calls: Column) -> Column:
    """A negative score gains 0.05 per tool call over two (and loses as much below), but stays at most -0.6; others pass."""
    return F.when(score < 0, F.least(F.lit(-0.6), score + (F.coalesce(calls, F.lit(0)) - 2) / 2 * 0.1)).otherwise(score)


def multi_agent_rewards(df: DataFrame, group: str, role: str, reward: str, correct: float, incorrect: float) -> DataFrame:
    """Every reward of a group times `correct` where its selector's reward is 1, else (also without a selector) times `incorrect`."""
    right = df.groupBy(F.col(group).alias("__g")).agg(F.max(F.coalesce((F.col(role) == "selector") & (F.col(reward) == 1), F.lit(False))).alias("__right"))
    weight = F.when(F.col("__right"), F.lit(correct)).otherwise(F.lit(incorrect))
    return df.join(right, F.col(group).eqNullSafe(F.col("__g"))).withColumn(reward, F.col(reward) * weight).drop("__g", "__right")


def ensemble(df: DataFrame, by: list[str], utility: str = "task_utility", leakage: str = "leakage", lam: float = LAMBDA) -> DataFrame:
    """Equal-weight means over an ensemble and the reward of the means."""
    rows = df.groupBy(*by).agg(F.avg(utility).alias("task_utility"), F.avg(leakage).alias("leakage"))
    return rows.withColumn("reward", utility_reward(F.col("task_utility"), F.col("leakage"), lam))


def group_normalised(df: DataFrame, group: str, reward: str, out: str = "advantage", std: bool = True) -> DataFrame:
    """r - mean, over the sample deviation + 1e-6 with std; one aggregate joined back, so a hot group is no window."""
    s = df.groupBy(group).agg(F.avg(reward).alias("__m"), F.stddev_samp(reward).alias("__s"))
    gap = F.col(reward) - F.col("__m")
    value = F.when(F.col("__s").isNull(), F.when(gap.isNotNull(), F.lit(None).cast("double"))).otherwise(gap / (F.col("__s") + 1e-6)) if std else gap
    return df.join(s, group).withColumn(out, value).drop("__m", "__s")


def bounded_group_normalised(df: DataFrame, group: str, reward: str, out: str = "normalised", eps: float = 1e-8) -> DataFrame:
    """Normalised by mean and population deviation of the rewards within [0, 1]; others pass as they are.

    A group of zeros is unchanged, one without variance becomes 0. A group with no reward in range
    stays as it is.
    """
    inside = F.col(reward).between(0, 1)
    s = df.groupBy(group).agg(F.avg(F.when(inside, F.col(reward))).alias("__m"), F.stddev_pop(F.when(inside, F.col(reward))).alias("__s"), F.max(F.when(inside, F.col(reward))).alias("__x"))
    value = F.when(~inside | F.col("__x").isNull() | (F.col("__x") == 0), F.col(reward)).when(F.col("__s") < eps, 0.0).otherwise((F.col(reward) - F.col("__m")) / (F.col("__s") + eps))
    return df.join(s, group).withColumn(out, F.when(F.col(reward).isNotNull(), value)).drop("__m", "__s", "__x")


def group_verdicts(df: DataFrame, group: str, value: str = "reward_value", eligible: str = "training_eligible", category: str = "reward_category", floor: float = 0.0, retain: bool = False) -> DataFrame:
    """Per group: keep or drop, the reason, and whether all its failures are infrastructure's.

    An ineligible member drops the group with its category counts; no spread, or a population
    deviation below the floor, drops or (with retain) keeps it. Null eligibility is ineligible.
    """
    ok = F.coalesce(F.col(eligible), F.lit(False))
    name = F.coalesce(F.col(category), F.lit("invalid_reward"))
    counted = df.groupBy(group, F.when(~ok, name).alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(ok, F.col(value))).alias("k"), F.sum(F.when(ok, F.col(value))).alias("s"), F.sum(F.when(ok, F.col(value) * F.col(value))).alias("q"),
        F.min(F.when(ok, F.col(value))).alias("lo"), F.max(F.when(ok, F.col(value))).alias("hi"),
    )
    g = counted.groupBy(group).agg(
        F.sum("n").alias("size"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("c").isin(*INFRASTRUCTURE_FAILURES), F.col("n")).otherwise(0)).alias("infra"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.concat_ws("_", "c", F.col("n").cast("string"))))), "+").alias("why"),
        F.sum("k").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    std = F.sqrt(F.greatest(F.col("q") / F.col("k") - F.pow(F.col("s") / F.col("k"), 2), F.lit(0.0)))
    flat, low = F.col("lo") == F.col("hi"), std < floor
    reason = (
        F.when(F.col("bad") > 0, F.concat(F.lit("ineligible_"), "why"))
        .when(flat, F.concat(F.lit("retained_" * retain + "zero_std_"), F.bround("lo", 2).cast("string")))
        .when(low, F.concat(F.lit("retained_" * retain + "low_std_"), F.bround(std, 4).cast("string")))
        .otherwise("accepted")
    )
    keep = (F.col("bad") == 0) & (F.lit(retain) | ~(flat | low))
    return g.select(group, "size", keep.alias("keep"), reason.alias("reason"), (F.col("infra") == F.col("size")).alias("infra_failure"))


def breaker(verdicts: DataFrame, order: str, threshold: int = 3) -> DataFrame:
    """Consecutive all-infrastructure failures up to each group in order, and whether the breaker is open.

    Islands by counting resets: the order is cut into blocks of BREAKER_ROWS rows, each block is summed
    up, and the sums are carried on, so that no single window holds all groups, wherever their ids lie.
    """
    placed = with_position(verdicts, [order], "__pos").withColumn("__b", F.floor(F.col("__pos") / BREAKER_ROWS))
    inside = Window.partitionBy("__b").orderBy(order)
    reset = (~F.col("infra_failure")).cast("int")
    local = placed.withColumn("__r", F.sum(reset).over(inside))
    local = local.withColumn("__n", F.sum(F.col("infra_failure").cast("int")).over(Window.partitionBy("__b", "__r").orderBy(order)))
    ends = placed.groupBy("__b").agg(F.sum(reset).alias("resets"), F.count(F.lit(1)).alias("rows"), F.max(F.when(~F.col("infra_failure"), F.col(order))).alias("last"))
    tails = placed.join(ends, "__b").where(F.col("last").isNull() | (F.col(order) > F.col("last"))).groupBy("__b").agg(F.count(F.lit(1)).alias("tail"))
    # One row per block: fold the open tails of earlier blocks.
    folded = ends.join(tails, "__b", "left").withColumn("tail", F.coalesce("tail", F.lit(0)))
    w = Window.orderBy("__b")
    run = folded.withColumn("__g", F.sum((F.col("resets") > 0).cast("int")).over(w)).withColumn("__upto", F.sum("tail").over(Window.partitionBy("__g").orderBy("__b")))
    carried = run.withColumn("carry", F.coalesce(F.lag("__upto").over(w), F.lit(0))).select("__b", "carry")
    count = F.when(F.col("infra_failure"), F.col("__n") + F.when(F.col("__r") == 0, F.col("carry")).otherwise(0)).otherwise(0)
    out = local.join(carried, "__b").withColumn("consecutive_failures", count.cast("long"))
    return out.withColumn("breaker_open", F.col("consecutive_failures") >= threshold).select(*verdicts.columns, "consecutive_failures", "breaker_open")
