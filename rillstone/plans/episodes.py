"""Queries over attempts, fills, judges' ranges and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators import episodes
from rillstone.plans.rollouts import group_verdicts, samples, token_series
from rillstone.sources.tables import table


def fill_drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why groups were dropped until 40 were kept, in group order."""
    return episodes.fill_report(group_verdicts(spark, d), "group_index", 40)


def solved_questions(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "label", "reward").select("label", F.col("reward.reward_value").alias("r"))
    return episodes.solved(s, "label", "r").select("label", F.round("mean_reward", 6).alias("mean_reward"))


def judge_ranges(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "reward").select("reward.record_id", "reward.task_utility", "reward.leakage").where("record_id is not null")
    r = episodes.ranges(s, ["record_id"], ["task_utility", "leakage"])
    return r.select("record_id", *[F.round(c, 6).alias(c) for c in r.columns if c != "record_id"])


def token_and_sample_means(spark: SparkSession, d: str) -> DataFrame:
    r = episodes.mean_kinds(token_series(spark, d), "rollout", "loss_mask")
    return r.select(F.round("mean_of_means", 6).alias("mean_of_means"), F.round("token_mean", 6).alias("token_mean"))


def turn_statistics(spark: SparkSession, d: str) -> DataFrame:
    r = episodes.turn_statistics(table(spark, d, "buffer_item", "messages").where("messages is not null"), "messages")
    return r.select("most_rounds", "most_chars", "least_chars", F.round("mean_rounds", 6).alias("mean_rounds"), F.round("mean_chars", 6).alias("mean_chars"))


def first_attempts(spark: SparkSession, d: str) -> DataFrame:
    """The first sidecar attempt of each record that has a prompt hash."""
    s = table(spark, d, "audit_sidecar", "record_id", "attempt", "prompt_sha256").where("attempt is not null").distinct()
    return episodes.first_valid_attempt(s, ["record_id"], "attempt", F.col("prompt_sha256").isNotNull()).select("record_id", "attempt", "attempts", "repaired")


def remaining_samples(spark: SparkSession, d: str) -> DataFrame:
    """Repeats still to sample so that each MIU record has 8."""
    ids = table(spark, d, "miu_record", F.concat(F.lit("MIU:"), "id").alias("label")).where("label is not null")
    left = episodes.remaining_repeats(ids, samples(spark, d, "label").where("label is not null"), "label", 8)
    return left.groupBy("label").agg(F.count(F.lit(1)).alias("left"))


def shuffled_options(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "reasoning_eval", "id", "choices", "answer").where("choices is not null")
    x = episodes.shuffled_choices("id", "choices", "answer", 3)
    return e.select("id", x["letter"].alias("letter"), F.array_join(x["choices"], "|").alias("choices"))


def judge_grid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eil_record", "id").where("id is not null").distinct()
    return episodes.grid(e, adversary=["a", "b"], temperature=[0.3, 0.6, 0.8, 1.0]).groupBy("adversary", "temperature").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (fill_drop_reasons, solved_questions, judge_ranges, token_and_sample_means, turn_statistics, first_attempts, remaining_samples, shuffled_options, judge_grid)}

_S = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"index\") AS rn FROM rollout_sample) q WHERE rn = 1)"
ORACLES = {
    "fill_drop_reasons": f"""WITH {_S}, g AS (SELECT group_index, count(*) FILTER (WHERE NOT coalesce(reward.training_eligible, false)) AS bad, min(reward.reward_value) AS lo, max(reward.reward_value) AS hi FROM s GROUP BY 1),
c AS (SELECT group_index, array_to_string(list_sort(list(k || '_' || n)), '+') AS why FROM (SELECT group_index, coalesce(reward.reward_category, 'invalid_reward') AS k, count(*) AS n FROM s WHERE NOT coalesce(reward.training_eligible, false) GROUP BY 1, 2) q GROUP BY 1),
v AS (SELECT g.group_index, bad = 0 AND lo <> hi AS keep, CASE WHEN bad > 0 THEN 'ineligible_' || why WHEN lo = hi THEN 'zero_std' ELSE 'accepted' END AS reason FROM g LEFT JOIN c USING (group_index)),
k AS (SELECT group_index, row_number() OVER (ORDER BY group_index) AS i FROM v WHERE keep)
SELECT reason, count(*) AS groups FROM v WHERE NOT keep AND group_index <= (SELECT max(group_index) FROM k WHERE i <= 40) GROUP BY 1""",
    "solved_questions": f"WITH {_S} SELECT label, round(avg(reward.reward_value), 6) AS mean_reward FROM s GROUP BY 1 HAVING avg(reward.reward_value) > 0",
    "judge_ranges": f"""WITH {_S} SELECT reward.record_id AS record_id, round(min(reward.task_utility), 6) AS task_utility_min, round(max(reward.task_utility), 6) AS task_utility_max, round(max(reward.task_utility) - min(reward.task_utility), 6) AS task_utility_range,
  round(min(reward.leakage), 6) AS leakage_min, round(max(reward.leakage), 6) AS leakage_max, round(max(reward.leakage) - min(reward.leakage), 6) AS leakage_range FROM s WHERE reward.record_id IS NOT NULL GROUP BY 1""",
    "token_and_sample_means": f"""WITH {_S}, k AS (SELECT "index", loss_mask[i] AS m, CAST(rollout_log_probs[i] AS DOUBLE) AS v FROM s, unnest(range(1, len(loss_mask) + 1)) u(i) WHERE rollout_log_probs IS NOT NULL), g AS (SELECT sum(v * m) AS s, sum(m) AS n FROM k GROUP BY "index")
SELECT round(avg(s / greatest(n, 1)), 6) AS mean_of_means, round(sum(s) / sum(n), 6) AS token_mean FROM g""",
    "turn_statistics": """WITH t AS (SELECT list_transform(list_filter(messages, lambda m: m.role = 'assistant'), lambda m: length(m.content)) AS l FROM buffer_item WHERE messages IS NOT NULL), r AS (SELECT len(l) AS rounds, coalesce(list_sum(l), 0) AS chars FROM t)
SELECT max(rounds) AS most_rounds, CAST(max(chars) AS BIGINT) AS most_chars, CAST(min(chars) AS BIGINT) AS least_chars, round(avg(rounds), 6) AS mean_rounds, round(avg(chars), 6) AS mean_chars FROM r""",
    "first_attempts": """WITH s AS (SELECT DISTINCT record_id, attempt, prompt_sha256 FROM audit_sidecar WHERE attempt IS NOT NULL)
SELECT record_id, coalesce(min(attempt) FILTER (WHERE prompt_sha256 IS NOT NULL), max(attempt)) AS attempt, count(*) AS attempts, count(prompt_sha256) > 0 AS repaired FROM s GROUP BY 1""",
    "remaining_samples": f"""WITH {_S}, n AS (SELECT label, count(*) AS n FROM s GROUP BY 1) SELECT 'MIU:' || id AS label, 8 - coalesce(n, 0) AS "left" FROM (SELECT DISTINCT id FROM miu_record WHERE id IS NOT NULL) m LEFT JOIN n ON n.label = 'MIU:' || id WHERE coalesce(n, 0) < 8""",
    "shuffled_options": """WITH c AS (SELECT id, answer, choices[i] AS c, CAST(('0x' || substr(sha256('3|' || id || '|' || (i - 1)), 1, 16)) AS UBIGINT) AS h FROM reasoning_eval, unnest(range(1, len(choices) + 1)) u(i)),
g AS (SELECT id, any_value(answer) AS answer, list(c ORDER BY h) AS l FROM c GROUP BY 1)
SELECT id, CASE WHEN list_position(l, answer) > 0 THEN chr(CAST(64 + list_position(l, answer) AS INT)) END AS letter, array_to_string(l, '|') AS choices FROM g""",
    "judge_grid": "SELECT a AS adversary, t AS temperature, count(*) AS n FROM (SELECT DISTINCT id FROM eil_record WHERE id IS NOT NULL) e, unnest(['a', 'b']) x(a), unnest([0.3, 0.6, 0.8, 1.0]::DOUBLE[]) y(t) GROUP BY 1, 2",
}
