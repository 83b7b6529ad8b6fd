"""Attempts, fills, repeats, grids and small projections of rollout and evaluation episodes."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.functions import graders
from rillstone.functions.hashing import joined, seed64
from rillstone.functions.text import last_fenced, tag_body
from rillstone.operators.selection import with_position


def load_callable(name: str) -> Callable:
    """The function that "package.module.name" names, for plug-in generators, graders and filters."""
    module, _, attribute = name.rpartition(".")
    if not module:
        raise ValueError(f"{name!r} names no module")
    return getattr(importlib.import_module(module), attribute)


# --- attempts and fills -------------------------------------------------------------------


def first_valid_attempt(attempts: DataFrame, keys: list[str], attempt: str, valid: Column) -> DataFrame:
    """Per candidate its first valid attempt, or its last one if none is valid (then `repaired` is false).

    One pre-aggregated minimum and maximum of structs; no candidate's attempts are gathered.
    """
    row = F.struct(F.col(attempt).alias("__a"), *[F.col(c) for c in attempts.columns])
    g = attempts.groupBy(*keys).agg(F.min(F.when(valid, row)).alias("good"), F.max(row).alias("last"), F.count(F.lit(1)).alias("attempts"))
    pick = F.coalesce("good", "last")
    return g.select(*[pick[c].alias(c) for c in attempts.columns], "attempts", F.col("good").isNotNull().alias("repaired"))


def filled(verdicts: DataFrame, order: str, target: int) -> DataFrame:
    """The first `target` kept groups in order, as a loop that submits until it has enough would take them."""
    kept = with_position(verdicts.where("keep"), [order], "place")
    return kept.where(F.col("place") < target)


def fill_report(verdicts: DataFrame, order: str, target: int) -> DataFrame:
    """Why groups before the fill's end were dropped: (reason, groups)."""
    end = filled(verdicts, order, target).agg(F.max(order).alias("__end"))
    # One row.
    seen = verdicts.join(F.broadcast(end)).where(F.col("__end").isNull() | (F.col(order) <= F.col("__end")))
    return seen.where("not keep").groupBy("reason").agg(F.count(F.lit(1)).alias("groups"))


def popped(queue: DataFrame, order: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """(the first n rows of a queue, the rest)."""
    placed = with_position(queue, order)
    return placed.where(F.col("__pos") < n).drop("__pos"), placed.where(F.col("__pos") >= n).drop("__pos")


def remaining_repeats(prompts: DataFrame, done: DataFrame, key: str, repeats: int) -> DataFrame:
    """(key, repeat): the repeats of each prompt still to run; each listing of a done key takes one off."""
    finished = done.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    left = prompts.select(key).distinct().join(finished, F.col(key) == F.col("__k"), "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    return left.where(F.col("__n") < repeats).select(key, F.explode(F.sequence(F.col("__n").cast("int") + 1, F.lit(repeats))).alias("repeat"))


def solved(samples: DataFrame, question: str, reward: str) -> DataFrame:
    """Questions with a mean reward above 0; null rewards are left out."""
    return samples.groupBy(question).agg(F.avg(reward).alias("mean_reward")).where("mean_reward > 0")


def consensus(a: DataFrame, b: DataFrame, key: str, label: str, old: DataFrame) -> DataFrame:
    """Two judges' labels and the old one: (key, label, outcome) with accepted, changed, disagree or missing."""
    x, y, o = (d.select(F.col(key).alias(f"{n}k"), F.col(label).alias(n)) for d, n in ((a, "x"), (b, "y"), (old, "o")))
    rows = o.join(x, F.col("ok") == F.col("xk"), "left").join(y, F.col("ok") == F.col("yk"), "left")
    outcome = F.when(F.col("x").isNull() | F.col("y").isNull(), "missing").when(F.col("x") != F.col("y"), "disagree").when(F.col("x").eqNullSafe(F.col("o")), "accepted").otherwise("changed")
    return rows.select(F.col("ok").alias(key), F.when(F.col("x") == F.col("y"), F.col("x")).alias(label), outcome.alias("outcome"))


def grid(df: DataFrame, **axes: list) -> DataFrame:
    """Every row with every combination of the axes' few values, by exploding literals."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return df


def ranges(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """min, max and their difference of each metric per group."""
    return df.groupBy(*by).agg(*[c for m in metrics for c in (F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), (F.max(m) - F.min(m)).alias(f"{m}_range"))])


def numeric_deltas(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, metric, delta): after less before for the numeric columns that both have."""
    numbers = lambda d: {c for c, t in d.dtypes if t in ("int", "bigint", "double", "float", "smallint") or t.startswith("decimal")}
    shared = sorted((numbers(before) & numbers(after)) - {key})
    long = lambda d, n: d.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(n)) for c in shared])).alias("m")).select(key, "m.*")
    return long(before, "old").join(long(after, "new"), [key, "metric"]).select(key, "metric", (F.col("new") - F.col("old")).alias("delta")).where("delta is not null")


def mean_kinds(series: DataFrame, value: str, mask: str) -> DataFrame:
    """One row: the mean of the samples' masked means, and the mean over all unmasked tokens."""
    per = series.select(F.aggregate(F.zip_with(value, mask, lambda v, m: v.cast("double") * m), F.lit(0.0), lambda a, x: a + x).alias("s"), F.aggregate(mask, F.lit(0.0), lambda a, m: a + m).alias("n"))
    return per.agg(F.avg(F.col("s") / F.greatest("n", F.lit(1.0))).alias("mean_of_means"), F.try_divide(F.sum("s"), F.sum("n")).alias("token_mean"))


def turn_statistics(df: DataFrame, messages: str, role: str = "assistant") -> DataFrame:
    """One row: rounds per conversation and characters per turn of a role."""
    t = F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: F.char_length(m["content"]))
    rows = df.select(F.size(t).alias("rounds"), F.aggregate(t, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("chars"))
    return rows.agg(F.avg("rounds").alias("mean_rounds"), F.max("rounds").alias("most_rounds"), F.avg("chars").alias("mean_chars"), F.max("chars").alias("most_chars"), F.min("chars").alias("least_chars"))


# --- projections --------------------------------------------------------------------------


def shuffled_choices(key: Column | str, choices: Column | str, answer: Column | str, seed: int) -> Column:
    """struct(choices, letter): the options in a hashed order and the letter of the answer, null if it is none of them."""
    choices, answer = (F.col(c) if isinstance(c, str) else c for c in (choices, answer))
    order = F.transform(choices, lambda c, i: F.struct(seed64(joined(F.lit(str(seed)), key, i.cast("string"))).alias("h"), c.alias("c")))
    mixed = F.transform(F.array_sort(order), lambda x: x["c"])
    at = F.array_position(mixed, answer)
    return F.struct(mixed.alias("choices"), F.when(at > 0, F.char(at.cast("int") + 64)).alias("letter"))


def merged_metadata(*maps: Column) -> Column:
    """Maps laid over one another; the last value of a key stands, null maps add nothing."""
    none = F.create_map().cast("map<string,string>")

    def over(low: Column, high: Column) -> Column:
        return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)

    out = F.coalesce(maps[0], none)
    for m in maps[1:]:
        out = over(out, F.coalesce(m, none))
    return out


def recovered_slots(scores: Column) -> Column:
    """The slots of a score map with a score above 0, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(scores, lambda _, v: F.coalesce(v, F.lit(0.0)) > 0)))


def tool_call(c: Column | str) -> Column:
    """struct(kind, content) of a response: a boxed answer, a tool_call element, a code element, fenced code, in that order."""
    c = F.col(c) if isinstance(c, str) else c
    box = F.nullif(F.regexp_extract(c, r"(?s)Answer:\s*\\boxed\{(.*)\}", 1), F.lit(""))
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    options = [("answer", box), ("tool", strip(tag_body(c, "tool_call"))), ("code", strip(tag_body(c, "code"))), ("code", strip(last_fenced(c)))]
    return F.coalesce(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.alias("content"))) for k, v in options])


def cut_after_call(c: Column | str, closing: tuple[str, ...] = ("</tool_call>", "</search>", "</answer>", "</code>")) -> Column:
    """The text through its first closing tag; whole without one."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(F.regexp_extract(c, "(?s)^(.*?(?:" + "|".join(closing) + "))", 1), F.lit("")), c)


def json_objects(text: str | None, keys: tuple[str, ...]) -> list[dict]:
    """Every JSON object in a text with exactly these keys, after the thinking block, in order."""
    text = (text or "").rsplit("</think>", 1)[-1]
    decoder, out, at = json.JSONDecoder(), [], text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            end = at + 1
        else:
            if isinstance(value, dict) and set(value) == set(keys):
                out.append(value)
        at = text.find("{", end)
    return out


def json_object(keys: tuple[str, ...]) -> Callable:
    """A column function: the last object with exactly these keys, as JSON text."""

    @F.pandas_udf(T.StringType())
    def found(text: pd.Series) -> pd.Series:
        return text.map(lambda t: json.dumps(got[-1], ensure_ascii=False) if (got := json_objects(t, keys)) else None)

    return found


def graded(kind: Column | str, response: Column | str, truth: Column | str, n_options: Column | int = 4) -> Column:
    """The grader named by `kind` (boxed_ before it takes the last box): f1, em, letter, math; null for others."""
    kind, response, truth = (F.col(c) if isinstance(c, str) else c for c in (kind, response, truth))
    plain = F.regexp_replace(kind, "^boxed_", "")
    box = F.nullif(F.regexp_extract(response, r"(?s).*\\boxed\{([^{}]*)\}", 1), F.lit(""))
    r = F.when(kind.startswith("boxed_"), box).otherwise(response)
    options = F.lit(n_options) if isinstance(n_options, int) else n_options
    return (
        F.when(plain == "f1", graders.token_f1(r, truth)["f1"]).when(plain == "em", graders.exact_match(r, F.array(truth)).cast("double"))
        .when(plain == "letter", F.coalesce((graders.option_letter(r, options) == truth).cast("double"), F.lit(0.0))).when(plain == "math", graders.math_reward(r, truth))
    )


def latest_rank(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows of the latest `order` of each group, all of them at a tie."""
    w = Window.partitionBy(*by)
    return df.withColumn("__x", F.max(order).over(w)).where(F.col(order).eqNullSafe(F.col("__x"))).drop("__x")


def buffered_first(buffer: DataFrame, dataset: DataFrame, order: list[str], n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the next n groups, what stays in the buffer, what stays of the dataset): the buffer's groups first, the rest from the dataset.

    One row is one group; order must be unique in each side.
    """
    taken, waiting = popped(buffer, order, n)
    more, left = popped(dataset, order, max(0, n - taken.count()))
    return taken.withColumn("buffered", F.lit(True)).unionByName(more.withColumn("buffered", F.lit(False)), allowMissingColumns=True), waiting, left


def carried_over(df: DataFrame, group: str, rollout_id: int, status: str = "status", response: str = "response", start: str = "start_rollout_id") -> DataFrame:
    """All rows of the groups with an aborted sample, to be queued again; a sample that has begun to respond
    is marked with the rollout it began in, once."""
    stopped = df.where(F.col(status) == "aborted").select(group).distinct()
    begun = F.when(F.col(response).isNotNull() & (F.col(response) != ""), F.lit(rollout_id))
    return df.join(stopped, group, "left_semi").withColumn(start, F.coalesce(F.col(start), begun))


def metric_reached(evals: DataFrame, metric: str, threshold: float) -> DataFrame:
    """One row: evaluations, those without the metric, and whether it reached the threshold in any; false where one lacks it."""
    lacking = F.count_if(F.col(metric).isNull())
    hit = F.coalesce(F.max(F.col(metric) >= threshold), F.lit(False))
    return evals.agg(F.count(F.lit(1)).alias("evaluations"), lacking.alias("missing"), (hit & (lacking == 0)).alias("reached"))
