"""The pN_ queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillstone.llm import defects, mixing, overlaps, quotas, spans, splits, tokens
from rillstone.llm.sql import ORACLES as ORACLES
from rillstone.sources.tables import table


def _category_sample(spark: SparkSession, d: str) -> quotas.CategorySample:
    columns = ("id", *quotas.CATEGORIES)
    pool = quotas.record_pool(table(spark, d, "miu_record", *columns), table(spark, d, "eil_record", *columns))
    return quotas.sample_by_targets(pool, table(spark, d, "category_target"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _category_sample(spark, d).report.where("cannot_meet").select("plan_id", "cell_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _category_sample(spark, d).report


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _category_sample(spark, d).sample


def p1_margins(spark: SparkSession, d: str) -> DataFrame:
    return _category_sample(spark, d).margins()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.cross_split(table(spark, d, "miu_record")).record_pairs(cross=True).select("id_1", "id_2").distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlap_report(p2_found(spark, d), table(spark, d, "miu_record"), table(spark, d, "audit_sidecar"))


def _new_splits(spark: SparkSession, d: str) -> splits.NewSplits:
    return splits.assign_splits(table(spark, d, "miu_record"), table(spark, d, "audit_sidecar"), table(spark, d, "split_target"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _new_splits(spark, d).mended(table(spark, d, "miu_record"))


def p4_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _new_splits(spark, d).assigned


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _new_splits(spark, d).report()


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    return _new_splits(spark, d).checks()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.small_edits(table(spark, d, "miu_record"), table(spark, d, "eil_record")).record_pairs()


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.small_edits(table(spark, d, "miu_record"), table(spark, d, "eil_record")).classes()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.broken_pairs(table(spark, d, "rollout_sample"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("defect").count().withColumnRenamed("count", "samples")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p7_lengths(spark: SparkSession, d: str) -> DataFrame:
    return tokens.length_report(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_target")).report().where("short").select("mix_id", "source")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_target")).report()


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_target")).draws


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_target")).checks()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(table(spark, d, "documents"))


def p9_families(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_families(table(spark, d, "documents"))


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_coverage(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_sample, p1_margins, p2_found, p2_report, p3_found, p3_report, p4_found, p4_assignment, p4_report, p4_checks, p6_found, p6_groups, p7_ids, p7_lengths, p8_found, p8_report, p8_mix, p8_checks, p9_found, p9_families, p9_coverage)}
