"""Queries over rollout samples, buffer items and evaluations: rewards, groups, series, selection, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstone.functions import graders, sequences, stats, text
from rillstone.operators import decisions, merging, packing, retrieval, rewards, selection
from rillstone.session import own_folder
from rillstone.sources.tables import table
from rillstone.streaming import buffer


def samples(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Rollout samples, each index once (a redelivered row repeats it)."""
    return table(spark, d, "rollout_sample", *dict.fromkeys(("index", *columns))).dropDuplicates(["index"])


def visible_answers(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "response", "status")
    return s.select("index", F.char_length(text.strip_thinking("response")).alias("visible_chars"), text.visible_problem("response", "status").alias("problem"))


def problem_counts(spark: SparkSession, d: str) -> DataFrame:
    return visible_answers(spark, d).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def group_norm_rewards(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "group_index", "reward").select("index", "group_index", F.col("reward.reward_value").alias("r"))
    return rewards.group_normalised(s, "group_index", "r").select("index", F.round("advantage", 6).alias("advantage"))


def group_verdicts(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "group_index", "reward").select("group_index", "reward.*")
    return rewards.group_verdicts(s, "group_index").select("group_index", "size", "keep", F.when(F.col("reason").startswith("ineligible"), F.col("reason")).when(F.col("reason").startswith("zero"), "zero_std").otherwise(F.col("reason")).alias("reason"), "infra_failure")


def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    return group_verdicts(spark, d).where("not keep").groupBy("reason").agg(F.count(F.lit(1)).alias("groups"))


def breaker_state(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "group_index", "status")
    v = s.groupBy("group_index").agg((F.count_if(F.coalesce(F.col("status"), F.lit("aborted")).isin("aborted", "pending", "truncated")) > 0).alias("infra_failure"))
    return rewards.breaker(v, "group_index", 2)


def zero_std_groups(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "group_index", "reward")
    g = s.groupBy("group_index").agg(F.min("reward.reward_value").alias("lo"), F.max("reward.reward_value").alias("hi"))
    return g.where("lo = hi").groupBy(F.round("lo", 2).alias("reward")).agg(F.count(F.lit(1)).alias("groups"))


def reward_categories(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "reward")
    total = s.agg(F.count(F.lit(1)).alias("total"))
    # The total is one row.
    return s.groupBy(F.col("reward.reward_category").alias("category")).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("category", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def family_summary(spark: SparkSession, d: str) -> DataFrame:
    """Overall, by family, by family and scenario, in one pass."""
    s = samples(spark, d, "reward").select("reward.*")
    g = s.groupingSets([[], ["family_domain"], ["family_domain", "subscenario"]], "family_domain", "subscenario")
    rows = g.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("reward_category") != "scored").alias("n_failed"), F.avg("decision_exact_match").alias("em"), F.avg("reasoning_faithfulness").alias("faith"), F.avg("task_utility").alias("utility"), F.avg("leakage").alias("leakage"))
    return rows.select(F.col("level").cast("int").alias("level"), F.coalesce("family_domain", F.lit("-")).alias("family_domain"), F.coalesce("subscenario", F.lit("-")).alias("subscenario"), "n_total", "n_failed", *[F.round(c, 6).alias(c) for c in ("em", "faith", "utility", "leakage")])


def reward_distribution(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "reward").select("reward.mechanism", "reward.reward_value")
    r = stats.describe(s, "reward_value", ["mechanism"])
    return r.select(F.coalesce("mechanism", F.lit("-")).alias("mechanism"), "count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p25", "p50", "p75")])


def sample_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "response", "response_length", "status")
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("response_length"), 6).alias("mean_length"), F.round(F.percentile("response_length", 0.5), 6).alias("median_length"), F.round(F.avg((F.col("status") == "truncated").cast("double")), 6).alias("truncated"), F.count_if(text.has_repetition("response")).alias("repetitive"), F.round(F.avg(F.size(F.split(F.trim("response"), r"\s+"))), 6).alias("mean_words"))


def length_metrics(spark: SparkSession, d: str) -> DataFrame:
    """sample_metrics without its look for repetitions, which SQL cannot express."""
    s = samples(spark, d, "response", "response_length", "status")
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("response_length"), 6).alias("mean_length"), F.round(F.percentile("response_length", 0.5), 6).alias("median_length"), F.round(F.avg((F.col("status") == "truncated").cast("double")), 6).alias("truncated"), F.round(F.avg(F.size(F.split(F.trim("response"), r"\s+"))), 6).alias("mean_words"))


def pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "group_index", "reward")
    g = s.groupBy("group_index").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(F.coalesce(F.col("reward.reward_value"), F.lit(0.0)) > 0.5).cast("int").alias("c"))
    return g.agg(*[F.round(F.avg(stats.pass_at_k(F.col("n"), F.col("c"), k)), 6).alias(f"pass_{k}") for k in (1, 2, 4, 8)])


def decision_rewards(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "reward").select("index", "reward.*").where("mechanism = 'MIU'")
    r = rewards.final_decision_reward(F.col("decision_exact_match"), F.col("reasoning_faithfulness"), F.col("decision_exact_match").isNotNull(), F.col("reasoning_faithfulness").isNull())
    return s.select("index", F.round(r, 6).alias("reward"))


def leakage_levels(spark: SparkSession, d: str) -> DataFrame:
    """Severity-weighted exposure of each record, with scores made from the slots' text lengths."""
    e = table(spark, d, "eil_record", "id", "exploitable_slots").where("id is not null").dropDuplicates(["id"])
    scores = F.map_from_entries(F.transform("exploitable_slots", lambda s: F.struct(s["id"], (F.pmod(F.char_length(s["content"]), F.lit(4)) / 3.0).alias("v"))))
    x = rewards.severity_exposure(F.col("exploitable_slots"), scores)
    return e.select("id", F.round(x, 6).alias("exposure"), rewards.leakage_level(F.round(x, 6)).alias("leakage"))


def ensemble_rewards(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "reward").select("reward.*").where("mechanism = 'EIL' and task_utility is not null and leakage is not null")
    r = rewards.ensemble(s, ["record_id"])
    return r.select("record_id", *[F.round(c, 6).alias(c) for c in ("task_utility", "leakage", "reward")])


def token_series(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "tokens", "loss_mask", "rollout_log_probs").where("rollout_log_probs is not null and loss_mask is not null")
    train = F.transform("rollout_log_probs", lambda x, i: x.cast("double") + F.sin(i.cast("double")) * 0.1)
    return s.select("index", "tokens", "loss_mask", F.transform("rollout_log_probs", lambda x: x.cast("double")).alias("rollout"), train.alias("train"))


def masked_means(spark: SparkSession, d: str) -> DataFrame:
    t = token_series(spark, d)
    return t.select("index", F.round(sequences.masked_mean(F.col("rollout"), F.col("loss_mask")), 6).alias("mean_logp"), F.round(sequences.masked_sum(F.col("rollout"), F.col("loss_mask")), 5).alias("sum_logp"), sequences.response_length(F.col("loss_mask")).alias("response_tokens"))


def kl_forms(spark: SparkSession, d: str) -> DataFrame:
    t = token_series(spark, d)
    mean = lambda k: F.round(sequences.masked_mean(sequences.kl(F.col("train"), F.col("rollout"), k), F.col("loss_mask")), 6)
    return t.select("index", *[mean(k).alias(k) for k in ("k1", "k2", "k3", "low_var_kl")])


def gae_returns(spark: SparkSession, d: str) -> DataFrame:
    """Advantages of each user's event values taken as rewards, the running mean as value."""
    e = table(spark, d, "events", "event_id", "user_id", "ts", "value").where("value is not null")
    g = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("r"))
    half = F.transform("r", lambda x: x / 2)
    a = sequences.gae(F.col("r"), half, 0.9, 0.95)
    return g.select("user_id", F.size("r").alias("steps"), F.round(a[0], 4).alias("first_advantage"), F.round(F.element_at(a, -1), 4).alias("last_advantage"))


def importance_weights(spark: SparkSession, d: str) -> DataFrame:
    t = token_series(spark, d)
    w = lambda level, mode: F.aggregate(sequences.importance_weights(F.col("train"), F.col("rollout"), F.col("loss_mask"), level, mode, 0.9, 1.05), F.lit(0.0), lambda s, x: s + x)
    return t.select("index", F.round(w("token", "truncate"), 5).alias("token_truncate"), F.round(w("sequence", "clip"), 5).alias("sequence_clip"), F.round(w("geometric", "mask"), 5).alias("geometric_mask"))


def mismatch_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = token_series(spark, d)
    return t.select("index", *[F.round(v, 5).alias(k) for k, v in sequences.mismatch_metrics(F.col("train"), F.col("rollout"), F.col("loss_mask")).items()])


def whitened_rewards(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "reward").select("index", F.col("reward.reward_value").alias("r")).where("r is not null")
    m = s.agg(F.avg("r").alias("m"), F.var_samp("r").alias("v"))
    # The moments are one row.
    return s.join(F.broadcast(m)).select("index", F.round((F.col("r") - F.col("m")) / F.sqrt(F.col("v") + 1e-8), 6).alias("white"))


def best_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "reward", "weight_versions").select(F.try_element_at("weight_versions", F.lit(1)).alias("step"), "reward.*").where("step is not null")
    g = s.groupBy("step").agg(F.avg("decision_exact_match").alias("em"), F.avg("reasoning_faithfulness").alias("faith"), F.avg("task_utility").alias("utility"), (1 - F.avg("leakage")).alias("low_leakage"), F.avg((F.col("reward_category") == "scored").cast("double")).alias("valid"))
    parts = {c: F.col(c) for c in ("em", "faith", "utility", "low_leakage")}
    return selection.best_step(g, "step", parts, dict.fromkeys(parts, 1.0), F.col("valid") >= 0.5).select("step", F.round("score", 6).alias("score"))


def metric_deltas(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "ts", "value").groupBy(F.date_trunc("day", "ts").cast("date").alias("day")).agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count(F.lit(1)).alias("n"))
    rows = selection.with_deltas(e, "day", ["mean_value", "n"], ("n",))
    return rows.select(F.col("day").cast("string").alias("day"), "n", "mean_value", F.round("delta_mean_value", 6).alias("delta_mean_value"), "delta_n")


def task_schedule(spark: SparkSession, d: str) -> DataFrame:
    ids = samples(spark, d, "group_index").select("group_index").distinct()
    return selection.task_schedule(ids, "group_index", 7, 0.4, 200000).select("group_index", "task")


def balanced_assignment(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "miu_record", "id", "subscenario", "split").where("id is not null").groupBy("id").agg(F.max(text.slugify("subscenario")).alias("scenario"), F.max(F.lower(F.trim("split"))).alias("split"))
    b = selection.balanced_labels(m, ["scenario", "split"], "id", ["opt_1", "opt_2", "opt_3"])
    g = b.groupBy("scenario", "split").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("target") == o).alias(o) for o in ("opt_1", "opt_2", "opt_3")])
    return g.select("scenario", "split", "n", F.greatest("opt_1", "opt_2", "opt_3").alias("most"), F.least("opt_1", "opt_2", "opt_3").alias("least"))


def target_flows(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "miu_record", "subscenario", "baseline_decision").groupBy(text.slugify("subscenario").alias("scenario")).agg(*[F.count_if(F.col("baseline_decision.decision") == f"opt_{i}").alias(f"b{i}") for i in (1, 2, 3)])
    total = F.col("b1") + F.col("b2") + F.col("b3")
    q = [F.floor(total / 3) + (F.lit(i) < total % 3).cast("long") for i in range(3)]
    flows = selection.target_flow([F.col("b1"), F.col("b2"), F.col("b3")], q, F.lit(0))
    return m.select("scenario", *[f.alias(n) for n, f in flows.items()])


def newest_groups(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "buffer_item", "instance_id", "timestamp")
    return selection.newest_groups(b, "instance_id", "timestamp", 16).groupBy("instance_id").agg(F.count(F.lit(1)).alias("items"))


def buffer_norm(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "buffer_item", "instance_id", "uid", "reward").distinct()
    return buffer.normalised_buffer(b).select("instance_id", "uid", "reward", F.round("normalised", 6).alias("normalised"))


def buffer_groups(spark: SparkSession, d: str) -> DataFrame:
    g = buffer.batch_groups(table(spark, d, "buffer_item", "instance_id", "uid", "reward", "received_at"), 4)
    return g.groupBy("instance_id").agg(F.count(F.lit(1)).alias("groups"), F.round(F.sum(F.aggregate(F.transform("rewards", lambda r: F.coalesce(r, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)), 6).alias("rewards"))


def buffer_validity(spark: SparkSession, d: str) -> DataFrame:
    return buffer.valid_groups(table(spark, d, "buffer_item", "instance_id", "messages"), 4)


def buffer_meta(spark: SparkSession, d: str) -> DataFrame:
    return buffer.buffer_meta(table(spark, d, "buffer_item", "instance_id", "reward")).select("items", "groups", F.round("mean_size", 6).alias("mean_size"), F.round("mean_reward", 6).alias("mean_reward"))


def stream_group_buffer(spark: SparkSession, d: str) -> DataFrame:
    """The stream of buffer items, run to its end over the stored table, into a table in the shared folder."""
    import uuid

    schema = table(spark, d, "buffer_item").schema
    base, name = own_folder(spark), uuid.uuid4().hex
    path = f"{d}/buffer_item.parquet"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(_stream_folder(spark, path, f"{base}/in-{name}"))
    done = buffer.full_groups(stream, 4)
    q = done.writeStream.format("parquet").option("path", f"{base}/out-{name}").option("checkpointLocation", f"{base}/log-{name}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{base}/out-{name}").select("instance_id", "size", "timed_out", F.array_join("uids", ",").alias("uids"))


def _stream_folder(spark: SparkSession, path: str, copy: str) -> str:
    """A folder to stream from: the table's own, or for a single file a copy in the shared folder."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs).isDirectory():
        return path
    spark.read.parquet(path).write.parquet(copy)
    return copy


def retry_merge(spark: SparkSession, d: str) -> DataFrame:
    """Samples without a reward take the best one of their group."""
    s = samples(spark, d, "group_index", "reward").select("index", "group_index", F.col("reward.reward_value").alias("r"))
    best = s.groupBy("group_index").agg(F.max("r").alias("best"))
    again = s.where("r is null").join(best, "group_index").select("index", F.col("best").alias("r"))
    return merging.patched(s, again, "index", ["r"]).select("index", F.round("r", 6).alias("r"))


def label_join(spark: SparkSession, d: str) -> DataFrame:
    """Samples with their record, by namespaced label: how many of each task find one."""
    s = samples(spark, d, "label").select(merging.task_of("label").alias("task"), "label")
    miu, eil, ev = (table(spark, d, t, "id").distinct() for t in ("miu_record", "eil_record", "reasoning_eval"))
    known = merging.namespaced({"MIU": miu, "EIL": eil, "EVAL": ev}, "id").withColumnRenamed("id", "known")
    return s.join(known, F.col("label") == F.col("known"), "left").groupBy("task").agg(F.count(F.lit(1)).alias("samples"), F.count("known").alias("matched"))


def group_tasks(spark: SparkSession, d: str) -> DataFrame:
    return merging.single_task_groups(samples(spark, d, "group_index", "label"), "group_index", "label").groupBy("task").agg(F.count(F.lit(1)).alias("groups"))


def parsed_decisions(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d, "response", "label", "status").where("label like 'MIU:%' and status = 'completed' and response is not null")
    p = s.select(decisions.parsed_decision("response").alias("p"))
    return p.groupBy(F.coalesce("p.problem", F.lit("valid")).alias("outcome"), F.col("p.letter").alias("letter")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("p.reasons")).alias("reasons"))


def answer_f1(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "reasoning_eval", "id", "question", "answer")
    f = graders.token_f1("question", "answer")
    return e.select("id", *[F.round(f[k], 6).alias(k) for k in ("f1", "precision", "recall")], graders.exact_match("answer", F.array(F.upper("answer"))).alias("em"))


def graded_letters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "reasoning_eval", "id", "choices", "answer")
    letter = graders.option_letter(F.concat(F.lit("The answer is "), F.char(F.greatest(F.array_position("choices", F.col("answer")), F.lit(1)).cast("int") + 64)), F.size("choices"))
    return e.where("choices is not null").select("id", letter.alias("letter"))


def pack_lengths(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d, "response_length", "group_index").select("index", F.floor(F.col("group_index") / 8).alias("step"), F.greatest("response_length", F.lit(1)).alias("tokens"))


def first_fit_pack(spark: SparkSession, d: str) -> DataFrame:
    p = packing.packed(pack_lengths(spark, d), "step", "index", "tokens", "first_fit", 4096)
    return p.groupBy("step").agg(F.countDistinct("bin").alias("micro_batches"), F.sum("tokens").alias("tokens"))


def kk_pack(spark: SparkSession, d: str) -> DataFrame:
    p = packing.packed(pack_lengths(spark, d), "step", "index", "tokens", "karmarkar_karp", 4)
    g = p.groupBy("step", "bin").agg(F.sum("tokens").alias("t"))
    return g.groupBy("step").agg(F.max("t").alias("most"), F.min("t").alias("least"))


def sequence_packs(spark: SparkSession, d: str) -> DataFrame:
    """Packs of neighbouring samples, joined and split again; how many sequences and tokens of each of four lanes come back."""
    t = token_series(spark, d).where("tokens is not null").select("index", (F.col("index") % 4).alias("pack"), F.floor(F.col("index") / 64).alias("step"), "tokens")
    p = packing.joined_packs(t, ["pack", "step"], "index", "tokens")
    back = packing.split_packs(p, ["pack", "step"])
    return back.groupBy("pack").agg(F.count(F.lit(1)).alias("sequences"), F.sum(F.size("tokens")).alias("tokens"))


def shards(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "miu_record", "id").where("id is not null").distinct()
    return selection.with_position(m, ["id"], "pos").select((F.col("pos") % 4).alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


def replicated_prompts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "reasoning_eval", "id")
    return selection.replicated(e, 4, ["id"]).select("id", "group_index", "index")


def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 50, against all vectors."""
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    return retrieval.inner_product_topk(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).select("query", "vec_id", "rank", F.round("score", 3).alias("score"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every document whose id is divisible by 50, against all documents."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return retrieval.bm25_topk(docs, docs.where("doc_id % 50 = 0"), 5).select("query", "doc_id", "rank", F.round("score", 4).alias("score"))


def prefix_match(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    known = docs.where("length(text) >= 12").groupBy(F.substring("text", 1, 12).alias("p")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("p")
    known = known.unionAll(known.select(F.substring("p", 1, 6)))
    return retrieval.longest_prefix(docs, known, "doc_id", "text", "p", [6, 12]).select("doc_id", F.char_length("p").alias("matched"))


def prefix_match_whole(spark: SparkSession, d: str) -> DataFrame:
    """Each document's longest prefix, of any length, that another document opens with too."""
    return retrieval.shared_prefix(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def adversary_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of samples of one group: mean distance of their word sets, within the group."""
    s = samples(spark, d, "group_index", "response").select("group_index", "index", text.ascii_tokens(F.coalesce("response", F.lit(""))).alias("t"))
    a, b = s.select("group_index", F.col("index").alias("i"), F.array_distinct("t").alias("x")), s.select("group_index", F.col("index").alias("j"), F.array_distinct("t").alias("y"))
    p = a.join(b, "group_index").where("i < j")
    return p.groupBy("group_index").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(text.jaccard_distance(F.col("x"), F.col("y"))), 6).alias("mean_distance"))


def running_reward(spark: SparkSession, d: str) -> DataFrame:
    """Per group, the reward of each sample less that of the one before."""
    s = samples(spark, d, "group_index", "reward").select("group_index", "index", F.col("reward.reward_value").alias("r"))
    w = Window.partitionBy("group_index").orderBy("index")
    return s.select("index", F.round(F.col("r") - F.lag("r").over(w), 6).alias("delta"))


QUERIES = {
    f.__name__: f
    for f in (
        visible_answers, problem_counts, group_norm_rewards, group_verdicts, drop_reasons, breaker_state, zero_std_groups, reward_categories, family_summary, reward_distribution, sample_metrics, length_metrics, pass_at_k, decision_rewards, leakage_levels,
        ensemble_rewards, masked_means, kl_forms, gae_returns, importance_weights, mismatch_metrics, whitened_rewards, best_checkpoint, metric_deltas, task_schedule, balanced_assignment, target_flows, newest_groups, buffer_norm, buffer_groups,
        buffer_validity, buffer_meta, stream_group_buffer, retry_merge, label_join, group_tasks, parsed_decisions, answer_f1, graded_letters, first_fit_pack, kk_pack, sequence_packs, shards, replicated_prompts, embedding_topk, bm25_topk, prefix_match, prefix_match_whole,
        adversary_pairs, running_reward,
    )
}
_S = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"index\") AS rn FROM rollout_sample) q WHERE rn = 1)"
_VIS = "regexp_replace(regexp_replace(CASE WHEN regexp_matches(response, '(?i)</think>') THEN list_extract(regexp_split_to_array(response, '(?i)</think>\\s*'), -1) ELSE regexp_replace(response, '(?is)<think>.*?</think>\\s*', '', 'g') END, '(?:\\s*<\\|(?:im_end|endoftext)\\|>)+\\s*$', ''), '^[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+|[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+$', '', 'g')".replace("{{", "{").replace("}}", "}")
_PROBLEM = f"CASE WHEN response IS NULL THEN 'invalid_response_type' WHEN lower(status) = 'truncated' THEN 'truncated_rollout' WHEN regexp_matches(response, '(?i)<think>') AND NOT regexp_matches(response, '(?i)</think>') THEN 'incomplete_thinking' WHEN {_VIS} = '' THEN 'empty_visible_response' END"
_T = _S + """, t AS (SELECT "index", loss_mask AS m, list_transform(rollout_log_probs, lambda x: CAST(x AS DOUBLE)) AS r, list_transform(rollout_log_probs, lambda x, i: CAST(x AS DOUBLE) + sin(i - 1) * 0.1) AS t FROM s WHERE rollout_log_probs IS NOT NULL AND loss_mask IS NOT NULL)
, k AS (SELECT "index", i, m[i] AS m, r[i] AS r, t[i] AS t, t[i] - r[i] AS d FROM t, unnest(range(1, len(m) + 1)) u(i))"""
_VERDICT = """
, g AS (SELECT group_index, count(*) AS size, count(*) FILTER (WHERE NOT coalesce(reward.training_eligible, false)) AS bad, count(*) FILTER (WHERE NOT coalesce(reward.training_eligible, false) AND reward.reward_category IN ('judge_failure', 'eil_evaluator_failure')) AS infra,
  min(reward.reward_value) AS lo, max(reward.reward_value) AS hi FROM s GROUP BY 1),
c AS (SELECT group_index, array_to_string(list_sort(list(k || '_' || n)), '+') AS why FROM (SELECT group_index, coalesce(reward.reward_category, 'invalid_reward') AS k, count(*) AS n FROM s WHERE NOT coalesce(reward.training_eligible, false) GROUP BY 1, 2) q GROUP BY 1),
v AS (SELECT g.group_index, size, bad = 0 AND lo <> hi AS keep, CASE WHEN bad > 0 THEN 'ineligible_' || why WHEN lo = hi THEN 'zero_std' ELSE 'accepted' END AS reason, infra = size AS infra_failure FROM g LEFT JOIN c USING (group_index))"""

_BARE = r"regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g')"
_ARTICLE = r"regexp_replace({0}, '(^|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}])(?:a|an|the)($|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}])', '\1 \2', 'g')"


def _answer_words(e: str) -> str:
    """Twice, as two articles in a row share the blank between them."""
    return f"regexp_extract_all({_ARTICLE.format(_ARTICLE.format(_BARE.format(e)))}, '[^\\s]+')"


ORACLES = {
    "answer_f1": f"""
WITH w AS (SELECT id, answer, coalesce({_answer_words("question")}, []) AS p, coalesce({_answer_words("answer")}, []) AS t, coalesce(array_to_string({_answer_words("answer")}, ' ') = array_to_string({_answer_words("upper(answer)")}, ' '), false) AS em FROM reasoning_eval),
c AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(t, lambda y: y = x))))), 0) AS c, array_to_string(p, ' ') AS a, array_to_string(t, ' ') AS b FROM w),
k AS (SELECT *, c = 0 OR (a <> b AND (a IN ('yes', 'no', 'noanswer') OR b IN ('yes', 'no', 'noanswer'))) AS none FROM c)
SELECT id, round(CASE WHEN none THEN 0.0 ELSE 2.0 * c / (len(p) + len(t)) END, 6) AS f1, round(CASE WHEN none THEN 0.0 ELSE c / len(p) END, 6) AS precision, round(CASE WHEN none THEN 0.0 ELSE c / len(t) END, 6) AS recall, em FROM k""",
    "length_metrics": f"""WITH {_S} SELECT count(*) AS n, round(avg(response_length), 6) AS mean_length, round(median(response_length), 6) AS median_length, round(avg(CASE WHEN status IS NOT NULL THEN CAST(status = 'truncated' AS DOUBLE) END), 6) AS truncated,
  round(avg(len(regexp_split_to_array(trim(response), '\\s+'))), 6) AS mean_words FROM s""",
    "graded_letters": "SELECT id, CASE WHEN list_position(choices, answer) BETWEEN 1 AND len(choices) THEN chr(CAST(64 + list_position(choices, answer) AS INT)) WHEN len(choices) > 0 THEN 'A' END AS letter FROM reasoning_eval WHERE choices IS NOT NULL",
    "parsed_decisions": f"""WITH {_S}, l AS (SELECT list_transform(list_filter(list_transform(string_split({_VIS}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: regexp_replace(x, '^\\*\\*(.*)\\*\\*$', '\\1')) AS l FROM s WHERE label LIKE 'MIU:%' AND status = 'completed' AND response IS NOT NULL),
p AS (SELECT nullif(regexp_extract(coalesce(l[1], ''), '^Decision: ([A-C])$', 1), '') AS letter, l[2:] AS r FROM l)
SELECT CASE WHEN letter IS NULL THEN 'no_decision_line' WHEN len(r) < 1 THEN 'no_reason' WHEN len(r) > 4 THEN 'too_many_reasons' WHEN len(list_filter(r, lambda x: NOT starts_with(x, 'Reason: '))) > 0 THEN 'unexpected_line'
  WHEN len(list_filter(r, lambda x: NOT regexp_matches(x, '\\[E\\d+\\]'))) > 0 THEN 'uncited_reason' WHEN len(list_filter(r, lambda x: trim(regexp_replace(regexp_replace(x, '^Reason:\\s*', ''), '\\s*\\[E\\d+\\]', '', 'g')) = '')) > 0 THEN 'empty_reason' ELSE 'valid' END AS outcome,
  letter, count(*) AS n, CAST(sum(len(r)) AS BIGINT) AS reasons FROM p GROUP BY 1, 2""",
    "visible_answers": f'WITH {_S} SELECT "index", CAST(length({_VIS}) AS INT) AS visible_chars, {_PROBLEM} AS problem FROM s',
    "problem_counts": f"WITH {_S} SELECT {_PROBLEM} AS problem, count(*) AS n FROM s GROUP BY 1",
    "group_norm_rewards": f'WITH {_S} SELECT "index", round((reward.reward_value - avg(reward.reward_value) OVER w) / (stddev_samp(reward.reward_value) OVER w + 1e-6), 6) AS advantage FROM s WINDOW w AS (PARTITION BY group_index)',
    "group_verdicts": f"WITH {_S}{_VERDICT} SELECT * FROM v",
    "drop_reasons": f"WITH {_S}{_VERDICT} SELECT reason, count(*) AS groups FROM v WHERE NOT keep GROUP BY 1",
    "breaker_state": f"""WITH {_S}, v AS (SELECT group_index, count(*) FILTER (WHERE coalesce(status, 'aborted') IN ('aborted', 'pending', 'truncated')) > 0 AS infra_failure FROM s GROUP BY 1),
i AS (SELECT *, sum(CASE WHEN infra_failure THEN 0 ELSE 1 END) OVER (ORDER BY group_index) AS island FROM v),
r AS (SELECT group_index, infra_failure, CAST(CASE WHEN infra_failure THEN sum(CASE WHEN infra_failure THEN 1 ELSE 0 END) OVER (PARTITION BY island ORDER BY group_index) ELSE 0 END AS BIGINT) AS consecutive_failures FROM i)
SELECT *, consecutive_failures >= 2 AS breaker_open FROM r""",
    "zero_std_groups": f"WITH {_S}, g AS (SELECT group_index, min(reward.reward_value) AS lo, max(reward.reward_value) AS hi FROM s GROUP BY 1) SELECT round(lo, 2) AS reward, count(*) AS groups FROM g WHERE lo = hi GROUP BY 1",
    "reward_categories": f"WITH {_S} SELECT reward.reward_category AS category, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY 1",
    "family_summary": f"""WITH {_S}, r AS (SELECT reward.* FROM s)
SELECT CAST(grouping_id(family_domain, subscenario) AS INT) AS level, coalesce(family_domain, '-') AS family_domain, coalesce(subscenario, '-') AS subscenario, count(*) AS n_total, count(*) FILTER (WHERE reward_category <> 'scored') AS n_failed,
  round(avg(decision_exact_match), 6) AS em, round(avg(reasoning_faithfulness), 6) AS faith, round(avg(task_utility), 6) AS utility, round(avg(leakage), 6) AS leakage FROM r GROUP BY GROUPING SETS ((), (family_domain), (family_domain, subscenario))""",
    "reward_distribution": f"""WITH {_S} SELECT coalesce(reward.mechanism, '-') AS mechanism, count(reward.reward_value) AS count, round(avg(reward.reward_value), 6) AS mean, round(stddev_pop(reward.reward_value), 6) AS std,
  round(quantile_cont(reward.reward_value, 0.25), 6) AS p25, round(quantile_cont(reward.reward_value, 0.5), 6) AS p50, round(quantile_cont(reward.reward_value, 0.75), 6) AS p75 FROM s GROUP BY 1""",
    "pass_at_k": f"WITH {_S}, g AS (SELECT group_index, count(*) AS n, count(*) FILTER (WHERE coalesce(reward.reward_value, 0) > 0.5) AS c FROM s GROUP BY 1) SELECT "
    + ", ".join(f"round(avg(CASE WHEN n - c < {k} THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - {k}.0 / i)) END), 6) AS pass_{k}" for k in (1, 2, 4, 8))
    + " FROM g",
    "decision_rewards": f"""WITH {_S} SELECT "index", round(CASE WHEN reward.decision_exact_match IS NULL THEN -0.75 WHEN reward.reasoning_faithfulness IS NULL THEN NULL ELSE -1 + 1.5 * reward.decision_exact_match + 0.5 * reward.reasoning_faithfulness END, 6) AS reward FROM s WHERE reward.mechanism = 'MIU'""",
    "leakage_levels": """
WITH e AS (SELECT id, any_value(exploitable_slots) AS s FROM eil_record WHERE id IS NOT NULL GROUP BY 1), x AS (SELECT id, s[i] AS s FROM e, unnest(range(1, len(s) + 1)) u(i)),
w AS (SELECT id, CASE s.severity WHEN 'low' THEN 1 WHEN 'med' THEN 2 WHEN 'high' THEN 3 ELSE 0 END AS w, (length(s.content) % 4) / 3.0 AS v FROM x),
g AS (SELECT e.id, CASE WHEN e.s IS NULL THEN NULL ELSE round(coalesce(sum(w * v), 0) / greatest(coalesce(sum(w), 0), 1), 6) END AS exposure FROM e LEFT JOIN w ON e.id = w.id GROUP BY e.id, e.s)
SELECT id, exposure, CASE WHEN exposure = 0 THEN 0.0 WHEN exposure > 0.67 THEN 1.0 WHEN exposure > 0.33 THEN 0.67 WHEN exposure IS NOT NULL THEN 0.33 END AS leakage FROM g""",
    "ensemble_rewards": f"""WITH {_S} SELECT reward.record_id AS record_id, round(avg(reward.task_utility), 6) AS task_utility, round(avg(reward.leakage), 6) AS leakage, round(avg(reward.task_utility) - 0.35 / 0.65 * avg(reward.leakage), 6) AS reward
FROM s WHERE reward.mechanism = 'EIL' AND reward.task_utility IS NOT NULL AND reward.leakage IS NOT NULL GROUP BY 1""",
    "masked_means": f"""WITH {_T}, a AS (SELECT "index", sum(r * m) AS s, greatest(sum(m), 1) AS n, coalesce(count(*) - min(i) FILTER (WHERE m <> 0) + 1, 0) AS l FROM k GROUP BY 1) SELECT "index", round(s / n, 6) AS mean_logp, round(s, 5) AS sum_logp, CAST(l AS INT) AS response_tokens FROM a""",
    "kl_forms": f"""WITH {_T} SELECT "index", round(sum(d * m) / greatest(sum(m), 1), 6) AS k1, round(sum(d * d / 2 * m) / greatest(sum(m), 1), 6) AS k2, round(sum((exp(-d) - 1 + d) * m) / greatest(sum(m), 1), 6) AS k3, round(sum(least(greatest(exp(-d) - 1 + d, -10), 10) * m) / greatest(sum(m), 1), 6) AS low_var_kl FROM k GROUP BY 1""",
    "gae_returns": """
WITH RECURSIVE e AS (SELECT user_id, value AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
d AS (SELECT a.user_id, a.i, a.n, a.r + 0.9 * coalesce(b.r / 2, 0) - a.r / 2 AS d FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.i = a.i + 1),
x AS (SELECT user_id, i, n, d AS a FROM d WHERE i = n UNION ALL SELECT d.user_id, d.i, d.n, d.d + 0.9 * 0.95 * x.a FROM x JOIN d ON d.user_id = x.user_id AND d.i = x.i - 1)
SELECT user_id, CAST(max(n) AS INT) AS steps, round(max(CASE WHEN i = 1 THEN a END), 4) AS first_advantage, round(max(CASE WHEN i = n THEN a END), 4) AS last_advantage FROM x GROUP BY 1""",
    "importance_weights": f"""WITH {_T}, q AS (SELECT "index", sum(least(exp(least(greatest(d, -20), 20)), 1.05) * m) AS a, sum(d * m) AS sd, sum(m) AS n FROM k GROUP BY 1)
SELECT "index", round(a, 5) AS token_truncate, round(least(greatest(exp(least(greatest(sd, -20), 20)), 0.9), 1.05) * n, 5) AS sequence_clip, round(CASE WHEN exp(sd / greatest(n, 1)) BETWEEN 0.9 AND 1.05 THEN exp(sd / greatest(n, 1)) ELSE 0 END * n, 5) AS geometric_mask FROM q""",
    "whitened_rewards": f"""WITH {_S}, r AS (SELECT "index", reward.reward_value AS r FROM s WHERE reward.reward_value IS NOT NULL) SELECT "index", round((r - (SELECT avg(r) FROM r)) / sqrt((SELECT var_samp(r) FROM r) + 1e-8), 6) AS white FROM r""",
    "best_checkpoint": f"""WITH {_S}, g AS (SELECT weight_versions[1] AS step, avg(reward.decision_exact_match) AS a, avg(reward.reasoning_faithfulness) AS b, avg(reward.task_utility) AS c, 1 - avg(reward.leakage) AS d, avg(CASE WHEN reward.reward_category = 'scored' THEN 1.0 WHEN reward.reward_category IS NOT NULL THEN 0.0 END) AS v FROM s WHERE weight_versions[1] IS NOT NULL GROUP BY 1)
SELECT step, round((a + b + c + d) / 4, 6) AS score FROM g WHERE v >= 0.5 AND a + b + c + d IS NOT NULL ORDER BY (a + b + c + d) / 4 DESC, step LIMIT 1""",
    "metric_deltas": """
WITH e AS (SELECT CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS day, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY 1)
SELECT day, n, mean_value, round(mean_value - lag(mean_value) OVER (ORDER BY day), 6) AS delta_mean_value, -(n - lag(n) OVER (ORDER BY day)) AS delta_n FROM e""",
    "task_schedule": """
WITH g AS (SELECT DISTINCT group_index AS i, CAST(('0x' || substr(sha256('7:mixed-task-phase-v1'), 1, 16)) AS UBIGINT) / 18446744073709551616.0 AS phase FROM rollout_sample)
SELECT i AS group_index, CASE WHEN floor((i + 1) * 80000.0 / 200000.0 + phase) > floor(i * 80000.0 / 200000.0 + phase) THEN 'EIL' ELSE 'MIU' END AS task FROM g""",
    "balanced_assignment": """
WITH m AS (SELECT id, max(trim(regexp_replace(lower(subscenario), '[^a-z0-9]+', '_', 'g'), '_')) AS scenario, max(lower(trim(split))) AS split FROM miu_record WHERE id IS NOT NULL GROUP BY 1)
SELECT scenario, split, count(*) AS n, CAST(ceil(count(*) / 3.0) AS BIGINT) AS most, CAST(floor(count(*) / 3.0) AS BIGINT) AS least FROM m GROUP BY 1, 2""",
    "target_flows": """
WITH m AS (SELECT trim(regexp_replace(lower(subscenario), '[^a-z0-9]+', '_', 'g'), '_') AS scenario, count(*) FILTER (WHERE baseline_decision.decision = 'opt_1') AS b1, count(*) FILTER (WHERE baseline_decision.decision = 'opt_2') AS b2, count(*) FILTER (WHERE baseline_decision.decision = 'opt_3') AS b3 FROM miu_record GROUP BY 1),
q AS (SELECT *, (b1 + b2 + b3) // 3 + CASE WHEN (b1 + b2 + b3) % 3 > 0 THEN 1 ELSE 0 END AS q1, (b1 + b2 + b3) // 3 + CASE WHEN (b1 + b2 + b3) % 3 > 1 THEN 1 ELSE 0 END AS q2 FROM m),
l AS (SELECT *, greatest(0, q2 - b3, q1 + q2 - b2 - b3) AS n12 FROM q)
SELECT scenario, n12, b1 - n12 AS n13, q1 - (b3 - (q2 - n12)) AS n21, b2 - (q1 - (b3 - (q2 - n12))) AS n23, b3 - (q2 - n12) AS n31, q2 - n12 AS n32 FROM l""",
    "newest_groups": """
WITH g AS (SELECT instance_id, max(timestamp) AS t, count(*) AS items FROM buffer_item GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY t DESC NULLS LAST, instance_id) AS k FROM g)
SELECT instance_id, items FROM r WHERE k <= 16 AND instance_id IS NOT NULL""",
    "buffer_norm": """
WITH b AS (SELECT DISTINCT instance_id, uid, reward FROM buffer_item WHERE instance_id IS NOT NULL), g AS (SELECT instance_id, avg(reward) FILTER (WHERE reward BETWEEN 0 AND 1) AS m, stddev_pop(reward) FILTER (WHERE reward BETWEEN 0 AND 1) AS s, max(reward) FILTER (WHERE reward BETWEEN 0 AND 1) AS x FROM b GROUP BY 1)
SELECT instance_id, uid, reward + 0.0 AS reward, round(CASE WHEN reward IS NULL THEN NULL WHEN NOT reward BETWEEN 0 AND 1 OR x IS NULL OR x = 0 THEN reward WHEN s < 1e-8 THEN 0 ELSE (reward - m) / (s + 1e-8) END, 6) AS normalised FROM b JOIN g USING (instance_id)""",
    "buffer_validity": """
SELECT instance_id, count(*) AS size, count(*) FILTER (WHERE coalesce(trim(messages[-1].content) <> '', false)) AS answered, count(*) >= 4 AND count(*) FILTER (WHERE coalesce(trim(messages[-1].content) <> '', false)) >= 4 AS valid FROM buffer_item GROUP BY 1""",
    "buffer_meta": "WITH g AS (SELECT instance_id, count(*) AS n, sum(reward) AS s, count(reward) AS k FROM buffer_item GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS items, count(*) AS groups, round(avg(n), 6) AS mean_size, round(sum(s) / sum(k), 6) AS mean_reward FROM g",
    "retry_merge": f'WITH {_S} SELECT "index", round(coalesce(reward.reward_value, max(reward.reward_value) OVER (PARTITION BY group_index)), 6) AS r FROM s',
    "label_join": f"""WITH {_S}, k AS (SELECT 'MIU:' || id AS known FROM miu_record UNION SELECT 'EIL:' || id FROM eil_record UNION SELECT 'EVAL:' || id FROM reasoning_eval)
SELECT nullif(regexp_extract(label, '^([A-Z]+):', 1), '') AS task, count(*) AS samples, count(known) AS matched FROM s LEFT JOIN k ON label = known GROUP BY 1""",
    "group_tasks": f"""WITH {_S}, t AS (SELECT group_index, min(nullif(regexp_extract(label, '^([A-Z]+):', 1), '')) AS lo, max(nullif(regexp_extract(label, '^([A-Z]+):', 1), '')) AS hi, count(*) FILTER (WHERE nullif(regexp_extract(label, '^([A-Z]+):', 1), '') IS NULL) AS none FROM s GROUP BY 1)
SELECT CASE WHEN lo = hi AND none = 0 THEN lo END AS task, count(*) AS groups FROM t GROUP BY 1""",
    "mismatch_metrics": f"""WITH {_T}, q AS (SELECT "index", sum(t * m) / greatest(sum(m), 1) AS lt, sum(r * m) / greatest(sum(m), 1) AS lr, sum(-d * m) / greatest(sum(m), 1) AS kl, sum((exp(d) - d - 1) * m) / greatest(sum(m), 1) AS k3, sum(exp(2 * d) * m) / greatest(sum(m), 1) - 1 AS ct, exp(least(2 * sum(d * m), 40)) - 1 AS cs FROM k GROUP BY 1)
SELECT "index", round(exp(-lt), 5) AS train_ppl, round(exp(-lr), 5) AS rollout_ppl, round(lt - lr, 5) AS log_ppl_diff, round(abs(lt - lr), 5) AS log_ppl_abs_diff, round(exp(lr - lt), 5) AS ppl_ratio, round(kl, 5) AS kl, round(k3, 5) AS k3_kl, round(ct, 5) AS chi2_token, round(cs, 5) AS chi2_seq FROM q""",
    "sequence_packs": f"""WITH {_S} SELECT "index" % 4 AS pack, count(*) AS sequences, CAST(sum(len(tokens)) AS BIGINT) AS tokens FROM s WHERE rollout_log_probs IS NOT NULL AND loss_mask IS NOT NULL AND tokens IS NOT NULL GROUP BY 1""",
    "buffer_groups": """
WITH o AS (SELECT instance_id, uid, min(struct_pack(at := coalesce(received_at, TIMESTAMP '9999-12-31'), reward := reward)) AS m FROM buffer_item WHERE instance_id IS NOT NULL AND uid IS NOT NULL GROUP BY 1, 2),
r AS (SELECT instance_id, m.reward AS reward, (row_number() OVER (PARTITION BY instance_id ORDER BY m.at, uid) - 1) // 4 AS turn FROM o), g AS (SELECT instance_id, turn, count(*) AS n, sum(coalesce(reward, 0)) AS s FROM r GROUP BY 1, 2)
SELECT instance_id, count(*) AS groups, round(sum(s), 6) AS rewards FROM g WHERE n = 4 GROUP BY 1""",
    "shards": "WITH m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM (SELECT DISTINCT id FROM miu_record WHERE id IS NOT NULL) q) SELECT pos % 4 AS shard, count(*) AS n FROM m GROUP BY 1",
    "replicated_prompts": "WITH e AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS g FROM reasoning_eval) SELECT id, g AS group_index, g * 4 + c AS index FROM e, unnest(range(0, 4)) u(c)",
    "embedding_topk": """
WITH s AS (SELECT q.vec_id AS query, v.vec_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query, vec_id, CAST(rank AS INT) AS rank, round(score, 3) AS score FROM r WHERE rank <= 5""",
    "bm25_topk": """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), st AS (SELECT count(*) AS n, avg(coalesce(len(w), 0)) AS a FROM t),
q AS (SELECT DISTINCT doc_id AS query, unnest(w) AS term FROM t WHERE doc_id % 50 = 0), p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM t) x GROUP BY ALL),
f AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, a FROM (SELECT term, count(*) AS df FROM p GROUP BY 1) y, st),
s AS (SELECT query, doc_id, sum(idf * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len / a))) AS score FROM p JOIN f USING (term) JOIN q USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query, doc_id, CAST(rank AS INT) AS rank, round(score, 4) AS score FROM r WHERE rank <= 5""",
    "prefix_match": """
WITH k AS (SELECT substr(text, 1, 12) AS p FROM documents WHERE length(text) >= 12 GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, CAST(CASE WHEN length(text) >= 12 AND substr(text, 1, 12) IN (SELECT p FROM k) THEN 12 WHEN length(text) >= 6 AND substr(text, 1, 6) IN (SELECT substr(p, 1, 6) FROM k) THEN 6 END AS INT) AS matched FROM documents""",
    "adversary_pairs": f"""WITH {_S}, t AS (SELECT group_index, "index" AS i, list_distinct(regexp_extract_all(lower(coalesce(response, '')), '[a-z0-9]+')) AS x FROM s),
p AS (SELECT a.group_index, len(list_intersect(a.x, b.x)) AS c, len(a.x) + len(b.x) AS n FROM t a JOIN t b ON a.group_index = b.group_index AND a.i < b.i)
SELECT group_index, count(*) AS pairs, round(avg(CASE WHEN n - c > 0 THEN 1 - c / (n - c) ELSE 0 END), 6) AS mean_distance FROM p GROUP BY 1""",
    "running_reward": f'WITH {_S} SELECT "index", round(reward.reward_value - lag(reward.reward_value) OVER (PARTITION BY group_index ORDER BY "index"), 6) AS delta FROM s',
}
