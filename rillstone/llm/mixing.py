"""Problem 8: mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm.tokens import token_counts
from rillstone.operators.ranking import blocked_rank
from rillstone.session import materialize

SEED = 871


@dataclass(frozen=True)
class Mix:
    """plan: per mix and source what can be given; draws: (mix_id, source, doc_id, copies, n_tokens)."""

    plan: DataFrame
    draws: DataFrame

    def report(self) -> DataFrame:
        """Per mix and source: wanted, available and drawn tokens, the real share, and whether it falls short.

        A source is short where the draw has given each of its documents max_repeats times, and still
        fewer tokens than wanted.
        """
        drawn = self.draws.groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("drawn_tokens"), F.sum("copies").alias("drawn_documents"), F.max("copies").alias("most_repeats"))
        rows = self.plan.join(drawn, ["mix_id", "source"], "left")
        whole = self.draws.groupBy("mix_id").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mix_tokens"))
        rows = rows.join(whole, "mix_id", "left")
        exhausted = F.coalesce("drawn_documents", F.lit(0)) == F.col("available_documents") * F.col("max_repeats")
        short = exhausted & (F.coalesce("drawn_tokens", F.lit(0)) < F.col("wanted_tokens"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        return rows.select("mix_id", "source", "target_share", "max_repeats", "available_tokens", "wanted_tokens", "expected_copies", zero("drawn_tokens"), zero("drawn_documents"), zero("most_repeats"), F.coalesce(F.try_divide("drawn_tokens", "mix_tokens"), F.lit(0.0)).alias("actual_share"), short.alias("short"))

    def checks(self) -> DataFrame:
        """(mix_id, source, cap_kept, share_kept): no document above its cap; the tokens within the longest document
        of those wanted, or the source short."""
        rows = self.report().join(self.plan.select("mix_id", "source", "longest").distinct(), ["mix_id", "source"])
        room = F.coalesce("longest", F.lit(0)) + F.col("wanted_tokens") * 1e-6
        return rows.select("mix_id", "source", (F.col("most_repeats") <= F.col("max_repeats")).alias("cap_kept"), (F.col("short") | (F.abs(F.col("drawn_tokens") - F.col("wanted_tokens")) <= room)).alias("share_kept"))


def mix_plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Wanted and available tokens and the expected copies of each document, per mix and source."""
    by_source = counts.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count_if(F.col("n_tokens") > 0).alias("available_documents"), F.max("n_tokens").alias("longest"))
    total = counts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens"))
    # The total is one row.
    rows = targets.select("mix_id", "source", "target_share", "max_repeats", "budget_share").distinct().join(by_source, "source", "left").join(F.broadcast(total))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("available_tokens", "available_documents")})
    rows = rows.withColumn("wanted_tokens", F.col("target_share") * F.col("budget_share") * F.col("all_tokens"))
    copies = F.least(F.col("max_repeats").cast("double"), F.try_divide("wanted_tokens", "available_tokens"))
    return rows.withColumn("expected_copies", F.when(F.col("available_tokens") > 0, copies).otherwise(0.0))


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = SEED) -> Mix:
    """Draw documents so that each source fills its share of a mix's tokens.

    Every document of a source is expected equally often; the expectations are prefix-summed
    within the source, from the shortest documents to the longest and in a hashed order among
    equally long ones, one random offset per mix and source is added, and a document comes out
    once for each integer its stretch crosses, so never more often than max_repeats. In this
    order the drawn tokens of a source that is not short lie within its longest document of those
    wanted. Texts of no token are never drawn. A null source belongs to no mix; a source
    without documents is short of any positive share; with a null share, cap or budget nothing is
    drawn and the source is not short. Repeated document rows count as documents of their own,
    repeated target rows once.
    """
    counts = materialize(token_counts(docs), "token-counts")
    plan = materialize(mix_plan(counts, targets), "mix-plan")
    sized = counts.where("source is not null and n_tokens > 0").select("source", "doc_id", "n_tokens")
    shorter = Window.partitionBy("source").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    # One row per source and length.
    lengths = sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("__k"))
    starts = lengths.select("source", "n_tokens", F.coalesce(F.sum("__k").over(shorter), F.lit(0)).alias("__s"))
    ranked = blocked_rank(sized, ["source", "n_tokens"], ["doc_id"], seed, "__r").join(starts, ["source", "n_tokens"]).withColumn("rank", F.col("__s") + F.col("__r"))
    named = plan.where("expected_copies > 0 and max_repeats is not null").select("mix_id", "source", "expected_copies")
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("mix_id"), F.col("source")), F.lit(2**40)) / F.lit(2.0**40)
    upto = lambda r: F.floor(r * F.col("expected_copies") + offset)
    drawn = ranked.join(named, "source").withColumn("copies", (upto(F.col("rank") + 1) - upto(F.col("rank"))).cast("long"))
    return Mix(plan, drawn.where("copies > 0").select("mix_id", "source", "doc_id", "copies", "n_tokens"))
