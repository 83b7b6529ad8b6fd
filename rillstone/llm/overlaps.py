"""Problems 2 and 6: the same or nearly the same text in other splits, or in other records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.lsh import NearDuplicates, Settings, near_duplicates

#: TESTDATA.md: triples of words, similarity 0.5.
CROSS_SPLIT = Settings(threshold=0.5, words=3, signature="minhash", bands=128, rows=5, cross=True)
SMALL_EDITS = Settings(threshold=0.5, words=3, signature="oph", bands=128, rows=5)


def split_side(split: str = "split"):
    """1 for train, 2 for val and test (trimmed, any case), else null."""
    name = F.lower(F.trim(F.col(split)))
    return F.when(name == "train", 1).when(name.isin("val", "test"), 2)


def cross_split_units(miu: DataFrame) -> DataFrame:
    """One unit per record with a split and compared field: the request, and the cards' contents as one text."""
    sided = miu.select("id", split_side().alias("side"), "user_natural_language", F.col("clean_context.content").alias("cards")).where("side is not null and id is not null")
    request = sided.select(F.lit("user_natural_language").alias("field"), "id", "side", F.array("user_natural_language").alias("parts"))
    cards = sided.select(F.lit("clean_context").alias("field"), "id", "side", F.col("cards").alias("parts"))
    return request.unionAll(cards)


def cross_split(miu: DataFrame, settings: Settings = CROSS_SPLIT) -> NearDuplicates:
    """Near-duplicates between train and the evaluation splits.

    Minwise hash shingles in banded buckets; a bucket with one side alone yields nothing;
    exact Jaccard decides. Null, unknown and blank splits belong to neither side; null texts,
    null card lists and null cards add nothing; an id whose rows name several splits stands on
    each side it names. Empty tables give no pair.
    """
    return near_duplicates(cross_split_units(miu), settings)


def small_edit_units(miu: DataFrame, eil: DataFrame) -> DataFrame:
    one = miu.select(F.lit("user_natural_language").alias("field"), "id", F.lit(0).alias("side"), F.array("user_natural_language").alias("parts"))
    two = eil.select(F.lit("adversary_opening").alias("field"), "id", F.lit(0).alias("side"), F.array("adversary_opening").alias("parts"))
    return one.unionAll(two).where("id is not null")


def small_edits(miu: DataFrame, eil: DataFrame, settings: Settings = SMALL_EDITS) -> NearDuplicates:
    """Records whose text is another's with small changes, per field.

    One-permutation hashing with optimal densification in banded buckets with star-shaped
    edges. Null and empty texts are like nothing; repeated rows count once; rows without an
    id are left out, as no pair could name them.
    """
    return near_duplicates(small_edit_units(miu, eil), settings)


def sources_of(sidecar: DataFrame) -> DataFrame:
    """Each record's sources: the datasets its latest attempt cites (record_id, source), distinct."""
    latest = sidecar.groupBy(F.col("record_id").alias("rid")).agg(F.max("attempt").alias("latest"))
    rows = sidecar.join(latest, (sidecar.record_id == latest.rid) & sidecar.attempt.eqNullSafe(latest.latest))
    return rows.select("record_id", F.explode("source_packet.facts.source_ref.dataset").alias("source")).where("source is not null").distinct()


def overlap_report(pairs: DataFrame, miu: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Overlapping pairs and evaluation records by the evaluation record's split and source.

    A record citing several sources counts under each; one citing none under "none".
    """
    splits = miu.select("id", F.lower(F.trim("split")).alias("split")).distinct()
    ends = pairs.select(F.col("id_1").alias("id"), F.struct("id_1", "id_2").alias("pair")).unionAll(pairs.select("id_2", F.struct("id_1", "id_2")))
    held = ends.join(splits, "id").where("split in ('val', 'test')")
    named = held.join(sources_of(sidecar), F.col("id") == F.col("record_id"), "left")
    return named.groupBy("split", F.coalesce("source", F.lit("none")).alias("source")).agg(F.count_distinct("pair").alias("pairs"), F.count_distinct("id").alias("records"))
