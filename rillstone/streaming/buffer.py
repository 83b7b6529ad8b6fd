"""Streams: emitting full groups of buffered samples, and the failure breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillstone.operators.rewards import bounded_group_normalised
from rillstone.operators.selection import with_position

GROUP = "instance_id string, uids array<string>, rewards array<double>, size int, timed_out boolean"


def full_groups(stream: DataFrame, group_size: int, timeout_ms: int | None = None) -> DataFrame:
    """Emit each instance once it has group_size distinct items; items of an emitted group start a new one.

    Items redelivered (same uid) while their group waits count once; after it was emitted they count as
    new, since the state does not keep what it has given away. (batch_groups, which sees the whole table,
    counts every uid once.) With timeout_ms, a group that waits longer is given
    up and emitted as it is (timed_out); without, groups wait. State per instance is at most
    group_size items. stream: instance_id, uid, reward; null instances are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        uids, rewards = (list(x) for x in state.get) if state.exists else ([], [])
        done = []
        if state.hasTimedOut:
            done.append((key[0], uids, rewards, len(uids), True))
            state.remove()
        else:
            for b in batches:
                for uid, reward in zip(b["uid"], b["reward"]):
                    if uid not in uids:
                        uids.append(uid)
                        rewards.append(None if pd.isna(reward) else float(reward))
                    if len(uids) == group_size:
                        done.append((key[0], uids, rewards, group_size, False))
                        uids, rewards = [], []
            if uids:
                state.update((uids, rewards))
                if timeout_ms:
                    state.setTimeoutDuration(timeout_ms)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(done, columns=["instance_id", "uids", "rewards", "size", "timed_out"])

    how = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    items = stream.where("instance_id is not null and uid is not null").select("instance_id", "uid", F.col("reward").cast("double"))
    return items.groupBy("instance_id").applyInPandasWithState(step, GROUP, "uids array<string>, rewards array<double>", "append", how)


def batch_groups(items: DataFrame, group_size: int, order: str = "received_at") -> DataFrame:
    """Over a finished table: each instance's distinct items in arrival order, cut into full groups.

    Places are counted in one order of all instances and start anew at each, so that an instance with a
    tenth of the rows is no single window.
    """
    once = items.where("instance_id is not null and uid is not null").groupBy("instance_id", "uid").agg(F.min(F.struct(F.coalesce(order, F.lit("9999-12-31").cast("timestamp")).alias("at"), "reward")).alias("m"))
    placed = with_position(once.select("instance_id", "uid", F.col("m.at").alias("at"), "m.reward"), ["instance_id", "at", "uid"], "pos")
    begins = placed.groupBy("instance_id").agg(F.min("pos").alias("begin"))
    grouped = placed.join(begins, "instance_id").withColumn("turn", F.floor((F.col("pos") - F.col("begin")) / group_size))
    rows = grouped.groupBy("instance_id", "turn").agg(F.array_sort(F.collect_list(F.struct("at", "uid", "reward"))).alias("g"))
    return rows.where(F.size("g") == group_size).select("instance_id", F.transform("g", lambda x: x["uid"]).alias("uids"), F.transform("g", lambda x: x["reward"]).alias("rewards"), F.size("g").alias("size"))


def valid_groups(items: DataFrame, least: int) -> DataFrame:
    """Instances with at least `least` items, and as many whose last message is not blank."""
    last = F.try_element_at("messages", F.lit(-1))["content"]
    g = items.groupBy("instance_id").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.coalesce(F.trim(last) != "", F.lit(False))).alias("answered"))
    return g.withColumn("valid", (F.col("size") >= least) & (F.col("answered") >= least))


def buffer_meta(items: DataFrame) -> DataFrame:
    """One row: items, groups, mean group size and mean reward."""
    g = items.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"), F.sum("reward").alias("s"), F.count("reward").alias("k"))
    return g.agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("groups"), F.avg("n").alias("mean_size"), F.try_divide(F.sum("s"), F.sum("k")).alias("mean_reward"))


def merged_meta(metas: DataFrame) -> DataFrame:
    """Reads joined into one: counts summed, rewards weighted by items."""
    return metas.agg(F.sum("items").alias("items"), F.sum("groups").alias("groups"), F.try_divide(F.sum(F.col("mean_reward") * F.col("items")), F.sum("items")).alias("mean_reward"))


def normalised_buffer(items: DataFrame) -> DataFrame:
    """Buffer rewards normalised within their instance (see bounded_group_normalised)."""
    return bounded_group_normalised(items, "instance_id", "reward")


def breaker_stream(groups: DataFrame, threshold: int = 3) -> DataFrame:
    """The breaker over a stream of group verdicts (lane, at, group_index, infra_failure): after `threshold`
    all-infrastructure failures in a row of a lane each further one is reported open; any other outcome resets."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["at", "group_index"], kind="stable")
        out = []
        for g, infra in zip(rows["group_index"], rows["infra_failure"]):
            run = run + 1 if infra else 0
            out.append((key[0], int(g), run, run >= threshold))
        state.update((run,))
        yield pd.DataFrame(out, columns=["lane", "group_index", "consecutive_failures", "breaker_open"])

    return groups.groupBy("lane").applyInPandasWithState(step, "lane string, group_index long, consecutive_failures long, breaker_open boolean", "run long", "append", GroupStateTimeout.NoTimeout)
