"""Queries that assemble, filter and follow rows: digests, length filters, queues, rewards of episodes, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions import hashing, sequences, text
from rillstone.functions.taxonomies import NECESSARY_TAGS
from rillstone.operators import episodes, merging, rewards
from rillstone.operators.timelines import asof_join
from rillstone.plans.corpus import _tags_sql
from rillstone.plans.rollouts import samples, token_series
from rillstone.sources.tables import table

#: The fields a decision's input shows, and those a variant must leave as they are.
INPUT_FIELDS = ("id", "family_domain", "user_natural_language", "user_constraints", "user_preferences", "authorized_information", "decision_boundary", "clean_context")
FROZEN_FIELDS = ("user_natural_language", "user_constraints", "user_preferences", "authorized_information", "decision_boundary", "clean_context", "baseline_decision")


def input_digests(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "miu_record", *INPUT_FIELDS)
    return m.select("id", hashing.canonical_digest(m, INPUT_FIELDS).alias("digest")).distinct()


def frozen_digests(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "miu_record", "id", *FROZEN_FIELDS)
    return m.select("id", hashing.canonical_digest(m, FROZEN_FIELDS).alias("digest")).distinct()


def overlong_prompts(spark: SparkSession, d: str) -> DataFrame:
    """How many samples of each task a limit of 64 tokens keeps and drops; null tokens have length 0."""
    s = samples(spark, d, "label", "tokens")
    long = F.coalesce(F.size("tokens"), F.lit(0)) > 64
    return s.groupBy(merging.task_of("label").alias("task")).agg(F.count_if(~long).alias("kept"), F.count_if(long).alias("dropped"))


def redacted_metadata(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "metadata").select("index", text.redacted("metadata", ("SHARD", "token")).alias("m"))
    return s.select("index", F.try_element_at("m", F.lit("rollout_id")).alias("rollout_id"), F.try_element_at("m", F.lit("shard")).alias("shard"))


def heldout_tactics(spark: SparkSession, d: str) -> DataFrame:
    """The tactics of the test and val splits that train never uses."""
    e = table(spark, d, "eil_record", "split", "adversary_config").select(F.lower(F.trim("split")).alias("split"), F.explode("adversary_config.tactics").alias("tactic"))
    return merging.heldout(e.where("split in ('val', 'test')"), e.where("split = 'train'"), "tactic")


def carried_over_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups with an aborted sample, queued again: their samples, and how many had begun in rollout 7."""
    s = samples(spark, d, "group_index", "status", "response").withColumn("start_rollout_id", F.lit(None).cast("int"))
    return episodes.carried_over(s, "group_index", 7).groupBy("group_index").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("start_rollout_id") == 7).alias("begun"))


def metric_state(spark: SparkSession, d: str) -> DataFrame:
    """Whether any group's mean match reached 0.9, and how many have none."""
    s = samples(spark, d, "group_index", "reward").groupBy("group_index").agg(F.avg("reward.decision_exact_match").alias("em"))
    return episodes.metric_reached(s, "em", 0.9)


def tool_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Rewards with the bonus of tool calls, a sample's messages counting as its calls."""
    s = samples(spark, d, "reward", "messages").select("index", rewards.tool_use_reward(F.col("reward.reward_value"), F.coalesce(F.size("messages"), F.lit(0))).alias("r"))
    return s.select("index", F.round("r", 6).alias("reward"))


def selector_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Group rewards scaled by their selector, the group's sample whose index is a multiple of 8."""
    s = samples(spark, d, "group_index", "reward").select("index", "group_index", F.round("reward.reward_value").alias("reward"), F.when(F.col("index") % 8 == 0, "selector").otherwise("solver").alias("role"))
    return rewards.multi_agent_rewards(s, "group_index", "role", "reward", 1.2, 0.8).select("index", F.round("reward", 6).alias("reward"))


def teacher_advantages(spark: SparkSession, d: str) -> DataFrame:
    """Teacher less student log-probability, the train series as teacher's: its sum over a sample."""
    t = token_series(spark, d)
    return t.select("index", F.round(F.aggregate(sequences.distillation_advantages(F.col("rollout"), F.col("train")), F.lit(0.0), lambda a, x: a + x), 5).alias("advantage"))


def asof_values(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the same user's latest view at or before it."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    rows = asof_join(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id", "ts", "seen")
    return rows.select("event_id", F.col("seen.ts").alias("seen_at"), F.col("seen.value").alias("seen_value"))


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user's events, a pause of 12 hours ending one."""
    e = table(spark, d, "events", "ts", "user_id", "value")
    return e.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last")).select("user_id", F.col("w.start").alias("began"), "last", "events")


def cube_sums(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    c = li.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    return c.select(F.coalesce("l_returnflag", F.lit("-")).alias("l_returnflag"), F.coalesce("l_linestatus", F.lit("-")).alias("l_linestatus"), "level", "n", "quantity")


def taxonomy_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Tags of the documents, overall and by source, in one pass."""
    t = table(spark, d, "documents", "source", "text").select("source", F.explode(text.tags("text", NECESSARY_TAGS)).alias("tag"))
    g = t.groupingSets([["tag"], ["tag", "source"]], "tag", "source").agg(F.grouping("source").alias("all_sources"), F.count(F.lit(1)).alias("n"))
    return g.select("tag", F.when(F.col("all_sources") == 1, "(all)").otherwise(F.coalesce("source", F.lit("(null)"))).alias("source"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        input_digests, frozen_digests, overlong_prompts, redacted_metadata, heldout_tactics, carried_over_groups, metric_state, tool_rewards, selector_rewards, teacher_advantages, asof_values, session_windows, cube_sums,
        taxonomy_grouping_sets,
    )
}

_S = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"index\") AS rn FROM rollout_sample) q WHERE rn = 1)"
_TASK = "nullif(regexp_extract(label, '^([A-Z]+):', 1), '')"
#: Structs of the records with their fields in the order of the names.
_SORTED = {
    "user_constraints": "list_transform(user_constraints, lambda c: CASE WHEN c IS NOT NULL THEN struct_pack(content := c.content, id := c.id, type := c.type) END)",
    "user_preferences": "list_transform(user_preferences, lambda c: CASE WHEN c IS NOT NULL THEN struct_pack(content := c.content, id := c.id) END)",
    "authorized_information": "list_transform(authorized_information, lambda c: CASE WHEN c IS NOT NULL THEN struct_pack(authority := c.authority, id := c.id, name := c.name) END)",
    "decision_boundary": "CASE WHEN decision_boundary IS NOT NULL THEN struct_pack(options := list_transform(decision_boundary.options, lambda c: CASE WHEN c IS NOT NULL THEN struct_pack(id := c.id, label := c.label) END)) END",
    "clean_context": "list_transform(clean_context, lambda c: CASE WHEN c IS NOT NULL THEN struct_pack(authorized_by := c.authorized_by, content := c.content, id := c.id) END)",
    "baseline_decision": "CASE WHEN baseline_decision IS NOT NULL THEN struct_pack(conclusion := baseline_decision.conclusion, decision := baseline_decision.decision, grounded_on := baseline_decision.grounded_on) END",
}


def _digest_sql(fields: tuple[str, ...]) -> str:
    packed = ", ".join(f"{f} := {_SORTED.get(f, f)}" for f in sorted(fields))
    return f"SELECT DISTINCT id, sha256(CAST(to_json(struct_pack({packed})) AS VARCHAR)) AS digest FROM miu_record"


ORACLES = {
    "input_digests": _digest_sql(INPUT_FIELDS),
    "frozen_digests": _digest_sql(FROZEN_FIELDS),
    "overlong_prompts": f"WITH {_S} SELECT {_TASK} AS task, count(*) FILTER (WHERE coalesce(len(tokens), 0) <= 64) AS kept, count(*) FILTER (WHERE coalesce(len(tokens), 0) > 64) AS dropped FROM s GROUP BY 1",
    "redacted_metadata": f"""WITH {_S} SELECT "index", metadata['rollout_id'] AS rollout_id, CASE WHEN metadata['shard'] IS NOT NULL THEN '<redacted>' END AS shard FROM s""",
    "heldout_tactics": """
WITH e AS (SELECT lower(trim(split)) AS split, unnest(adversary_config.tactics) AS tactic FROM eil_record)
SELECT DISTINCT tactic FROM e WHERE split IN ('val', 'test') AND tactic IS NOT NULL AND tactic NOT IN (SELECT tactic FROM e WHERE split = 'train' AND tactic IS NOT NULL)""",
    "carried_over_groups": f"""WITH {_S} SELECT group_index, count(*) AS samples, count(*) FILTER (WHERE coalesce(response, '') <> '') AS begun FROM s WHERE group_index IN (SELECT group_index FROM s WHERE status = 'aborted') GROUP BY 1""",
    "metric_state": f"""WITH {_S}, g AS (SELECT group_index, avg(reward.decision_exact_match) AS em FROM s GROUP BY 1)
SELECT count(*) AS evaluations, count(*) FILTER (WHERE em IS NULL) AS missing, coalesce(bool_or(em >= 0.9), false) AND count(*) FILTER (WHERE em IS NULL) = 0 AS reached FROM g""",
    "tool_rewards": f"""WITH {_S} SELECT "index", round(CASE WHEN reward.reward_value < 0 THEN least(-0.6, reward.reward_value + (coalesce(len(messages), 0) - 2) / 2.0 * 0.1) ELSE reward.reward_value END, 6) AS reward FROM s""",
    "selector_rewards": f"""WITH {_S}, r AS (SELECT "index", group_index, round(reward.reward_value) AS r FROM s), g AS (SELECT group_index, coalesce(bool_or("index" % 8 = 0 AND r = 1), false) AS hit FROM r GROUP BY 1)
SELECT "index", round(r * CASE WHEN hit THEN 1.2 ELSE 0.8 END, 6) AS reward FROM r JOIN g ON r.group_index IS NOT DISTINCT FROM g.group_index""",
    "teacher_advantages": f"""WITH {_S} SELECT "index", round(coalesce(list_sum(list_transform(rollout_log_probs, lambda x, i: (CAST(x AS DOUBLE) + sin(i - 1) * 0.1) - CAST(x AS DOUBLE))), 0), 5) AS advantage FROM s WHERE rollout_log_probs IS NOT NULL AND loss_mask IS NOT NULL""",
    "asof_values": """
WITH v AS (SELECT user_id, ts, max(struct_pack(e := event_id, t := ts, u := user_id, y := event_type, v := value)) AS m FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT p.event_id, v.ts AS seen_at, v.m.v AS seen_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "session_windows": """
WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL),
w AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM o)
SELECT user_id, min(ts) AS began, max(ts) AS last, count(*) AS events FROM w GROUP BY user_id, session""",
    "cube_sums": """
SELECT coalesce(l_returnflag, '-') AS l_returnflag, coalesce(l_linestatus, '-') AS l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS INT) AS level, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "taxonomy_grouping_sets": f"""
WITH t AS (SELECT source, unnest({_tags_sql("text", NECESSARY_TAGS)}) AS tag FROM documents)
SELECT tag, '(all)' AS source, count(*) AS n FROM t GROUP BY 1 UNION ALL SELECT tag, coalesce(source, '(null)'), count(*) FROM t GROUP BY tag, source""",
}
