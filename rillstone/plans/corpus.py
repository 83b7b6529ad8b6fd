"""Queries over documents, records and sidecars: hashing, text, statistics, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions import hashing, stats, text
from rillstone.functions.taxonomies import ATTACK_TAGS, BOUNDARY_CUES, LEVERAGE_TAGS, NECESSARY_TAGS, RELEASE_BOUNDARY_CUES, STOPWORDS
from rillstone.operators import merging, planning, quality, similar
from rillstone.operators.selection import first_by_hash
from rillstone.session import materialize
from rillstone.sources.tables import table

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
NORM = "array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' ')"


def _terms(e: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({e}), '[a-z0-9]+'), lambda t: length(t) >= 4 AND t NOT IN ({STOP})))"


def _tags_sql(e: str, rules: dict[str, tuple[str, ...]]) -> str:
    cases = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(coalesce({e}, '')), '{n}')" for n in ns) + f" THEN '{name}' END" for name, ns in rules.items())
    found = f"list_filter([{cases}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE ['other'] END"


def corpus_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "text", "source")
    rows = docs.select(F.coalesce("source", F.lit("(none)")).alias("source"), text.normalized(F.coalesce("text", F.lit(""))).alias("n"), text.first_cue("text", RELEASE_BOUNDARY_CUES).alias("cue"))
    seen = rows.groupBy("source", stats.digest(F.col("n")).alias("h")).agg(F.count(F.lit(1)).alias("k"), F.count("cue").alias("cues"))
    return seen.groupBy("source").agg(F.sum("k").alias("documents"), F.sum(F.col("k") - 1).alias("duplicate_excess"), F.sum("cues").alias("boundary_cues"))


def _cues_sql(e: str, patterns: tuple[str, ...]) -> str:
    parts = []
    for p in patterns:
        q = p.replace("'", "''")
        parts.append(f"nullif(regexp_extract({e}, '(?is)({q})', 1), '')")
    return "coalesce(" + ", ".join(parts) + ")"


def split_bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id").groupBy(hashing.split_for("doc_id").alias("split")).agg(F.count(F.lit(1)).alias("n"))


def seed_pick(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_name")
    seed = hashing.seed64(hashing.joined(F.lit("plan"), "p_partkey"))
    return p.select("p_partkey", seed.alias("seed"), hashing.hashed_pick(F.array(*map(F.lit, ("low", "med", "high"))), seed).alias("level"), (hashing.seed31(F.col("p_name")) % 1000).alias("small"))


def cyclic_plan(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "audit_sidecar", "scenario", "ordinal").where("ordinal is not null").distinct()
    forms = ["direct", "situation first", "limits first", "comparison", "cautious", "urgent"]
    dims = ["budget", "timing", "access", "upkeep", "risk"]
    pair = planning.paired_choice(7, "scenario", "ordinal", dims)
    return s.select("scenario", "ordinal", planning.record_id("scenario", "ordinal").alias("id"), planning.axis_choice(7, "scenario", "ordinal", forms, "narrative_form").alias("form"), pair[0].alias("first_dim"), pair[1].alias("second_dim"))


def normalized_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return stats.duplicate_excess(table(spark, d, "documents", "text"), text.normalized(F.coalesce("text", F.lit(""))), "duplicate_excess")


def text_measures(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents", "doc_id", "text")
    return t.select("doc_id", text.ascii_word_count("text").alias("ascii_words"), F.size(text.terms("text")).alias("n_terms"), F.size(text.shingles(text.ascii_tokens("text"), 5)).alias("n_shingles"), F.char_length("text").alias("chars"))


def slug_categories(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "miu_record", "subscenario").unionAll(table(spark, d, "eil_record", "subscenario"))
    return m.groupBy(text.slugify("subscenario").alias("slug")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("subscenario").alias("spellings"))


def boundary_cue_flags(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "eil_record", "id", "user_natural_language")
    return m.select("id", F.lower(text.first_cue("user_natural_language", BOUNDARY_CUES)).alias("cue"), F.lower(text.first_cue("user_natural_language", RELEASE_BOUNDARY_CUES)).alias("release_cue")).distinct()


def tag_incidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eil_record", "family_domain", "necessary_information")
    return stats.incidence(e.select("family_domain", F.transform("necessary_information", lambda x: text.tags(x["content"], NECESSARY_TAGS)).alias("tags")), "tags", "family_domain")


def tag_mapped_share(spark: SparkSession, d: str) -> DataFrame:
    """Of the fields of tag_incidence, how many have a tag other than "other"."""
    e = table(spark, d, "eil_record", "family_domain", "necessary_information")
    return stats.mapped_share(e.select("family_domain", F.transform("necessary_information", lambda x: text.tags(x["content"], NECESSARY_TAGS)).alias("tags")), "tags", "family_domain")


def attack_tagsets(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "miu_record", "manipulated_context")
    return m.groupBy(text.tagset(F.transform("manipulated_context", lambda x: text.tags(x["attack"], ATTACK_TAGS))).alias("tagset")).agg(F.count(F.lit(1)).alias("n"))


def distribution_entropy(spark: SparkSession, d: str) -> DataFrame:
    return stats.distribution(table(spark, d, "miu_record", "family_domain", "subscenario"), "subscenario", ["family_domain"])


def event_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.distribution(table(spark, d, "events", "event_type"), "event_type")


def profile_nmi(spark: SparkSession, d: str) -> DataFrame:
    return quality.conditional_nmi(quality.eil_profiles(table(spark, d, "eil_record")))


def position_role_nmi(spark: SparkSession, d: str) -> DataFrame:
    return stats.nmi(quality.position_roles(table(spark, d, "miu_record")), "left", "right").select("records", F.round("nmi", 6).alias("nmi"))


def quantile_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_returnflag", "l_extendedprice")
    return stats.nearest_ranks(li, "l_extendedprice", {"p50": 0.5, "p95": 0.95}, ["l_returnflag"])


def describe_by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.describe(table(spark, d, "lineitem", "l_shipdate", "l_returnflag", "l_quantity"), "l_quantity", ["l_returnflag"])
    return rows.select("l_returnflag", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p25", "p50", "p75")])


def spearman_ranks(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_custkey", "o_totalprice").join(table(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return stats.spearman(o, "o_totalprice", "c_acctbal", ["c_mktsegment"]).select("c_mktsegment", "n", F.round("spearman", 6).alias("spearman"))


def item_overlaps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eil_record", "id", "necessary_information", "exploitable_slots").where("id is not null").dropDuplicates(["id"])
    pairs = e.select("id", F.explode("necessary_information").alias("n"), "exploitable_slots").select("id", "n", F.explode("exploitable_slots").alias("s"))
    return pairs.select("id", F.col("n.id").alias("nec"), F.col("s.id").alias("slot"), F.round(text.overlap("n.content", "s.content"), 6).alias("overlap"))


def overlap_summary(spark: SparkSession, d: str) -> DataFrame:
    o = materialize(item_overlaps(spark, d), "overlaps")
    flags = o.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg((F.col("overlap") >= 0.58).cast("double")), 6).alias("share_ge_058"))
    # One row each.
    return flags.join(F.broadcast(stats.nearest_ranks(o, "overlap", {"median": 0.5, "p95": 0.95})))


def eil_issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.issues(table(spark, d, "eil_record"), "id", quality.eil_rules())


def miu_issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.issues(table(spark, d, "miu_record"), "id", quality.miu_rules())


def miu_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    codes = ("option_set", "visible_not_union", "baseline_outside_closed_set", "baseline_not_grounded")
    return miu_issues(spark, d).where(F.col("code").isin(*codes)).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


def release_gate(spark: SparkSession, d: str) -> DataFrame:
    return quality.release_gate(eil_issues(spark, d), table(spark, d, "eil_record"), "user_natural_language")


def provenance_checks(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "miu_record", "id").unionAll(table(spark, d, "eil_record", "id"))
    return quality.provenance_issues(ids, table(spark, d, "audit_sidecar"))


def anchor_copies(spark: SparkSession, d: str) -> DataFrame:
    return quality.anchor_copies(table(spark, d, "miu_record", "id", "user_natural_language"), table(spark, d, "audit_sidecar"), "user_natural_language", 4)


def earlier_similar_requests(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "miu_record", "id", "user_natural_language").where("id is not null")
    return similar.earlier_similar(m, "id", "id", "user_natural_language")


def sidecar_profile_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return quality.profile_mismatches(table(spark, d, "miu_record").dropDuplicates(["id"]), table(spark, d, "audit_sidecar"), "id", {"num_clean": "num_clean", "num_mani": "num_mani"})


def latest_attempts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "audit_sidecar", "record_id", "attempt")
    return s.groupBy("record_id").agg(F.max("attempt").alias("latest"), F.count_distinct("attempt").alias("attempts"), F.count(F.lit(1)).alias("rows"))


def pending_records(spark: SparkSession, d: str) -> DataFrame:
    return merging.pending(table(spark, d, "miu_record", "id").distinct(), table(spark, d, "audit_sidecar", F.col("record_id").alias("id")), "id")


def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return merging.duplicate_keys(table(spark, d, "miu_record", "id"), "id")


def integrity_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The sidecars' scenarios against the records' subscenarios, both ways."""
    a = table(spark, d, "miu_record", "id", "subscenario").where("id is not null").groupBy("id").agg(F.max(text.slugify("subscenario")).alias("s"))
    s = table(spark, d, "audit_sidecar", "record_id", "scenario").groupBy(F.col("record_id").alias("id")).agg(F.max(text.slugify("scenario")).alias("s"))
    return merging.conflicts(a, s, "id", ["s"]).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def quarantine_counts(spark: SparkSession, d: str) -> DataFrame:
    miu = table(spark, d, "miu_record")
    bad, good = merging.quarantined(miu, quality.issues(miu, "id", [r for r in quality.miu_rules() if r.code == "baseline_not_grounded"]).withColumnRenamed("record_id", "id"), "id")
    return bad.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("quarantined")).unionAll(good.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("retained")))


def quarantine_all(spark: SparkSession, d: str) -> DataFrame:
    """Records of both mechanisms and their sidecars: how many a hard error of any rule quarantines, and how many are retained."""
    found = {t: quality.issues(table(spark, d, t), "id", rules) for t, rules in (("miu_record", quality.miu_rules()), ("eil_record", quality.eil_rules()))}
    bad = {t: materialize(quality.quarantine_ids(f).withColumnRenamed("record_id", "id"), "quarantine") for t, f in found.items()}
    bad["audit_sidecar"] = bad["miu_record"].unionAll(bad["eil_record"])
    counts = []
    for t, ids in bad.items():
        rows = table(spark, d, t, F.col("record_id").alias("id") if t == "audit_sidecar" else "id")
        for part, kept in zip(("quarantined", "retained"), merging.quarantined(rows, ids, "id")):
            counts.append(kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("source"), F.lit(part).alias("part"), "n"))
    return reduce(DataFrame.unionAll, counts)


def pair_join(spark: SparkSession, d: str) -> DataFrame:
    """A keyed join with its projection: line items with their part's brand."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return li.join(table(spark, d, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("pairs"), F.sum("l_quantity").alias("quantity"))


def namespaced_union(spark: SparkSession, d: str) -> DataFrame:
    u = merging.namespaced({"MIU": table(spark, d, "miu_record", "id", "split").distinct(), "EIL": table(spark, d, "eil_record", "id").distinct()}, "id")
    return u.groupBy(merging.task_of("id").alias("task")).agg(F.count(F.lit(1)).alias("n"), F.count("split").alias("with_split"))


def pilot_rows(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "miu_record", "id", "family_domain").where("id is not null").distinct()
    return first_by_hash(m, ["family_domain"], "id", 5, "pilot")


def corpus_report(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "miu_record", "family_domain", "split", "subscenario")
    return m.groupBy(text.slugify("family_domain").alias("family")).agg(F.count(F.lit(1)).alias("records"), F.count_distinct(F.lower(F.trim("split"))).alias("splits"), F.array_join(F.array_sort(F.collect_set(text.slugify("subscenario"))), "|").alias("scenarios"))


def option_positions(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "miu_record", "split", "baseline_decision")
    return m.groupBy(F.lower(F.trim("split")).alias("split")).agg(*[F.count_if(F.col("baseline_decision.decision") == o).alias(o) for o in ("opt_1", "opt_2", "opt_3")])


def prompt_projection(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "miu_record", "id", "user_natural_language", "decision_boundary", "external_information").dropDuplicates(["id"])
    return m.select(F.concat(F.lit("MIU:"), "id").alias("record_id"), planning.decision_messages("Decide for the user.").alias("messages")).select("record_id", F.size("messages").alias("n"), F.char_length(F.col("messages")[1]["content"]).alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        corpus_quality_gate, split_bucket_counts, seed_pick, cyclic_plan, normalized_duplicates, text_measures, slug_categories, boundary_cue_flags, tag_incidence, tag_mapped_share, attack_tagsets, distribution_entropy, event_distribution,
        profile_nmi, position_role_nmi, quantile_nearest_rank, describe_by_group, spearman_ranks, item_overlaps, overlap_summary, eil_issues, miu_issues, miu_issue_counts, release_gate, provenance_checks, anchor_copies,
        earlier_similar_requests, sidecar_profile_mismatches, latest_attempts, pending_records, repeated_ids, integrity_conflicts, quarantine_counts, quarantine_all, pair_join, namespaced_union, pilot_rows, corpus_report, option_positions, prompt_projection,
    )
}

_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"
_SEED = "CAST(('0x' || substr(sha256({0}), 1, 16)) AS UBIGINT)"
_DIST = """
n AS (SELECT {by} coalesce(CAST({v} AS VARCHAR), 'None') AS v, count(*) AS n FROM {t} GROUP BY ALL),
w AS (SELECT {by} CAST(sum(n) AS BIGINT) AS observations, count(*) AS support, max(n) AS top, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM n {group})
SELECT {by} observations, support, round(exp(h), 3) AS effective_support, CASE WHEN support > 1 THEN round(h / ln(support), 4) ELSE 1.0 END AS normalized_entropy, round(top / observations, 4) AS dominance FROM w"""
_NMI = """
p AS (SELECT {by} l AS x, r AS y, count(*) AS n FROM rows_ GROUP BY ALL),
j AS (SELECT {by} sum(n) AS t, sum(n * ln(n)) AS sxy FROM p {group}),
a AS (SELECT {by} sum(m * ln(m)) AS sx, count(*) AS kx FROM (SELECT {by} x, sum(n) AS m FROM p GROUP BY ALL) q {group}),
b AS (SELECT {by} sum(m * ln(m)) AS sy, count(*) AS ky FROM (SELECT {by} y, sum(n) AS m FROM p GROUP BY ALL) q {group})
SELECT {out} CAST(t AS BIGINT) AS records, CASE WHEN kx > 1 AND ky > 1 THEN round((ln(t) + (sxy - sx - sy) / t) / sqrt((ln(t) - sx / t) * (ln(t) - sy / t)), {places}) END AS nmi FROM j {join}"""
_NEC = "list_transform(necessary_information, lambda x: " + _tags_sql("x.content", NECESSARY_TAGS) + ")"

_TAGSET = "coalesce(nullif(array_to_string(list_sort(list_distinct(flatten({0}))), '|'), ''), 'other')"
_NMI_FAMILY = """
p AS (SELECT family_domain AS f, l AS x, r AS y, count(*) AS n FROM rows_ WHERE family_domain IS NOT NULL GROUP BY ALL), j AS (SELECT f, sum(n) AS t, sum(n * ln(n)) AS sxy FROM p GROUP BY 1),
a AS (SELECT f, sum(m * ln(m)) AS sx, count(*) AS kx FROM (SELECT f, x, sum(n) AS m FROM p GROUP BY ALL) q GROUP BY 1), b AS (SELECT f, sum(m * ln(m)) AS sy, count(*) AS ky FROM (SELECT f, y, sum(n) AS m FROM p GROUP BY ALL) q GROUP BY 1)
SELECT f AS family_domain, CAST(t AS BIGINT) AS records, CASE WHEN kx > 1 AND ky > 1 THEN round((ln(t) + (sxy - sx - sy) / t) / sqrt((ln(t) - sx / t) * (ln(t) - sy / t)), 4) END AS nmi FROM j JOIN a USING (f) JOIN b USING (f)"""

_EIL_FIELDS = ("id", "family_domain", "subscenario", "split", "user_natural_language", "adversary_opening", "necessary_information", "exploitable_slots", "adversary_config")
_MIU_FIELDS = ("id", "family_domain", "subscenario", "split", "user_natural_language", "decision_boundary", "clean_context", "manipulated_context", "external_information", "baseline_decision")


def _missing_sql(fields: tuple[str, ...]) -> str:
    return "unnest(list_filter([" + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in fields) + "], lambda x: x IS NOT NULL))"


def _wrong_ids_sql(t: str, items: str, prefix: str, code: str) -> str:
    return f"SELECT id, '{code}' AS code, 'hard' AS severity, coalesce({items}[i].id, '(null)') AS detail FROM {t}, unnest(range(1, len({items}) + 1)) u(i) WHERE {items}[i].id IS DISTINCT FROM '{prefix}_' || i"


def _overlaps_sql(left: str, right: str, at: str, code: str, severity: str) -> str:
    a, b = _terms(f"{left}.content"), _terms(f"{right}.content")
    share = f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"
    return f"SELECT id, '{code}', '{severity}', concat_ws('~', {left}.id, {right}.id) FROM e, unnest(range(1, len(n) + 1)) u(i), unnest(range(1, len(s) + 1)) w(j) WHERE {share} >= {at}"


_DISTINCT_SIZE = "(len(list_distinct({0})) + CASE WHEN len(list_filter({0}, lambda x: x IS NULL)) > 0 THEN 1 ELSE 0 END)"
_EIL_ISSUES = f"""
e AS (SELECT *, necessary_information AS n, exploitable_slots AS s, adversary_config.tactics AS tactics, [struct_pack(id := 'opening', content := coalesce(adversary_opening, ''))] AS o FROM eil_record),
issues AS (
  SELECT id, 'wrong_mechanism' AS code, 'hard' AS severity, '' AS detail FROM e WHERE NOT coalesce(upper(trim(mechanism)) = 'EIL', false)
  UNION ALL SELECT id, 'missing_field', 'hard', {_missing_sql(_EIL_FIELDS)} FROM e
  UNION ALL SELECT id, 'privacy_boundary_leak', 'hard', cue FROM (SELECT id, {_cues_sql("user_natural_language", RELEASE_BOUNDARY_CUES)} AS cue FROM e) q WHERE cue IS NOT NULL
  UNION ALL {_wrong_ids_sql("e", "n", "nec", "necessary_ids")} UNION ALL {_wrong_ids_sql("e", "s", "exp", "slot_ids")}
  UNION ALL SELECT id, 'severity_domain', 'hard', s[i].id FROM e, unnest(range(1, len(s) + 1)) u(i) WHERE NOT coalesce(s[i].severity IN ('low', 'med', 'high'), false)
  UNION ALL SELECT id, 'item_count', 'hard', '' FROM e WHERE NOT (len(n) BETWEEN 1 AND 5) OR NOT (len(s) BETWEEN 1 AND 5)
  UNION ALL {_overlaps_sql("n[i]", "s[j]", "0.58", "necessary_slot_overlap", "hard")}
  UNION ALL {_overlaps_sql("s[i]", "s[j]", "0.72", "slot_near_duplicate", "warning").replace("len(n)", "len(s)")} AND i < j
  UNION ALL {_overlaps_sql("o[i]", "s[j]", "0.70", "opening_repeats_hidden_slot", "warning").replace("len(n)", "len(o)")}
  UNION ALL SELECT id, 'invalid_adversary_tactics', 'hard', '' FROM e WHERE coalesce(len(tactics) < 1 OR {_DISTINCT_SIZE.format("tactics")} <> len(tactics), true)
  UNION ALL SELECT id, 'invalid_adversary_pressure', 'hard', '' FROM e WHERE NOT coalesce(adversary_config.pressure IN ('low', 'med', 'high'), false)
  UNION ALL SELECT id, 'count_mismatch', 'warning', '' FROM e WHERE len(n) <> meta.num_nec OR len(s) <> meta.num_exp)"""
_WORDS = r"len(regexp_extract_all(c.content, '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+'))"


def _mean_words_sql(cards: str) -> str:
    return f"CASE WHEN len({cards}) > 0 THEN list_sum(list_transform({cards}, lambda c: coalesce({_WORDS}, 0))) / len({cards}) END"


_MIU_ISSUES = f"""
m AS (SELECT *, coalesce(list_transform(clean_context, lambda c: c.id), []) AS cid, coalesce(list_transform(decision_boundary.options, lambda o: o.id), []) AS oid, decision_boundary.options AS opts, clean_context AS c, manipulated_context AS a,
  list_sort(coalesce(list_transform(external_information, lambda e: e.content), [])) AS e, list_transform(decision_boundary.options, lambda o: {NORM.format("o.label")}) AS labels,
  list_sort(list_concat(coalesce(list_transform(clean_context, lambda e: e.content), []), coalesce(list_transform(manipulated_context, lambda e: e.content), []))) AS h,
  coalesce(list_transform(authorized_information, lambda x: x.id), []) AS auth, list_transform(manipulated_context, lambda x: {NORM.format("x.attack")}) AS attacks FROM miu_record),
issues AS (
  SELECT id, 'wrong_mechanism' AS code, 'hard' AS severity, '' AS detail FROM m WHERE NOT coalesce(upper(trim(mechanism)) = 'MIU', false)
  UNION ALL SELECT id, 'missing_field', 'hard', {_missing_sql(_MIU_FIELDS)} FROM m
  UNION ALL SELECT id, 'option_set', 'hard', '' FROM m WHERE list_sort(oid) <> ['opt_1', 'opt_2', 'opt_3']
  UNION ALL SELECT id, 'option_labels', 'hard', '' FROM m WHERE labels IS NULL OR len(list_distinct(labels)) <> len(labels) OR list_contains(labels, '')
  UNION ALL SELECT id, 'visible_not_union', 'hard', '' FROM m WHERE e <> h
  UNION ALL SELECT id, 'baseline_outside_closed_set', 'hard', '' FROM m WHERE NOT coalesce(list_contains(oid, baseline_decision.decision), false)
  UNION ALL SELECT id, 'baseline_not_grounded', 'hard', '' FROM m WHERE coalesce(len(baseline_decision.grounded_on), 0) < 1 OR len(list_filter(baseline_decision.grounded_on, lambda g: NOT list_contains(cid, g))) > 0
  UNION ALL SELECT id, 'clean_context_unauthorized', 'hard', unnest(list_distinct(list_filter(list_transform(coalesce(c, []), lambda x: coalesce(x.authorized_by, '(null)')), lambda x: NOT list_contains(auth, x)))) FROM m
  UNION ALL {_wrong_ids_sql("m", "c", "clean", "clean_ids")} UNION ALL {_wrong_ids_sql("m", "a", "mani", "manipulated_ids")}
  UNION ALL SELECT id, 'pipeline_label_leak', 'hard', '' FROM m WHERE regexp_matches(user_natural_language, '{quality.PIPELINE_LABELS}')
  UNION ALL SELECT id, 'constraint_preference_mixing', 'hard', user_constraints[i].id FROM m, unnest(range(1, len(user_constraints) + 1)) u(i) WHERE regexp_matches(lower(user_constraints[i].content), 'prefer|ideally|would like|nice to have')
  UNION ALL SELECT id, 'preference_constraint_mixing', 'hard', user_preferences[i].id FROM m, unnest(range(1, len(user_preferences) + 1)) u(i) WHERE regexp_matches(user_preferences[i].content, '(?i)\\b(?:must|require|only|cannot|mandatory|non-negotiable)\\b')
  UNION ALL SELECT id, 'attack_mentions_baseline', 'warning', '' FROM m WHERE EXISTS (SELECT 1 FROM unnest(range(1, len(a) + 1)) u(i), unnest(range(1, len(opts) + 1)) w(j) WHERE opts[j].id = baseline_decision.decision AND labels[j] <> '' AND contains({NORM.format("a[i].content")}, labels[j]))
  UNION ALL SELECT id, 'duplicate_attack_labels', 'hard', '' FROM m WHERE {_DISTINCT_SIZE.format("attacks")} <> len(a)
  UNION ALL SELECT id, 'length_cue', 'warning', '' FROM m WHERE abs({_mean_words_sql("c")} - {_mean_words_sql("a")}) > 9
  UNION ALL SELECT id, 'count_mismatch', 'warning', '' FROM m WHERE len(c) <> meta.num_clean OR len(a) <> meta.num_mani)"""

ORACLES = {
    "eil_issues": f"WITH {_EIL_ISSUES} SELECT id AS record_id, code, severity, detail FROM issues",
    "miu_issues": f"WITH {_MIU_ISSUES} SELECT id AS record_id, code, severity, detail FROM issues",
    "release_gate": f"""WITH {_EIL_ISSUES}, g AS (SELECT count(*) FILTER (WHERE severity = 'hard') AS hard, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM issues),
d AS (SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS duplicate_requests FROM (SELECT {NORM.format("coalesce(user_natural_language, '')")} AS t, count(*) AS k FROM eil_record GROUP BY 1) q)
SELECT (SELECT count(*) FROM eil_record) AS records, hard, warnings, duplicate_requests, CASE WHEN hard = 0 AND duplicate_requests = 0 THEN 'pass' ELSE 'fail' END AS gate FROM g, d""",
    "quarantine_all": f"""WITH {_EIL_ISSUES.replace("issues AS", "eil_found AS")}, {_MIU_ISSUES.replace("issues AS", "miu_found AS")},
b AS (SELECT 'eil_record' AS source, id FROM eil_found WHERE severity = 'hard' UNION SELECT 'miu_record', id FROM miu_found WHERE severity = 'hard'),
r AS (SELECT 'miu_record' AS source, id, EXISTS (SELECT 1 FROM b WHERE b.source = 'miu_record' AND b.id IS NOT DISTINCT FROM t.id) AS bad FROM miu_record t
  UNION ALL SELECT 'eil_record', id, EXISTS (SELECT 1 FROM b WHERE b.source = 'eil_record' AND b.id IS NOT DISTINCT FROM t.id) FROM eil_record t
  UNION ALL SELECT 'audit_sidecar', record_id, EXISTS (SELECT 1 FROM b WHERE b.id IS NOT DISTINCT FROM t.record_id) FROM audit_sidecar t)
SELECT source, part, CASE part WHEN 'quarantined' THEN count(*) FILTER (WHERE bad) ELSE count(*) FILTER (WHERE NOT bad) END AS n FROM r, (VALUES ('quarantined'), ('retained')) p(part) GROUP BY source, part""",
    "tag_mapped_share": f"""
WITH f AS (SELECT family_domain AS g, unnest({_NEC}) AS tags FROM eil_record), k AS (SELECT DISTINCT family_domain AS g FROM eil_record),
w AS (SELECT '(all)' AS grp, count(*) AS fields, count(*) FILTER (WHERE tags = ['other']) AS unmapped FROM f
  UNION ALL SELECT coalesce(k.g, '(null)'), count(f.tags), count(*) FILTER (WHERE tags = ['other']) FROM k LEFT JOIN f ON k.g IS NOT DISTINCT FROM f.g GROUP BY k.g)
SELECT grp, fields, unmapped, CASE WHEN fields > 0 THEN round((fields - unmapped) / fields, 4) END AS mapped_rate FROM w""",
    "corpus_quality_gate": f"""
WITH r AS (SELECT coalesce(source, '(none)') AS source, {NORM.format("coalesce(text, '')")} AS n, {_cues_sql("text", RELEASE_BOUNDARY_CUES)} AS cue FROM documents),
s AS (SELECT source, n, count(*) AS k, count(cue) AS c FROM r GROUP BY ALL)
SELECT source, CAST(sum(k) AS BIGINT) AS documents, CAST(sum(k - 1) AS BIGINT) AS duplicate_excess, CAST(sum(c) AS BIGINT) AS boundary_cues FROM s GROUP BY source""",
    "split_bucket_counts": """
WITH b AS (SELECT CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 AS b FROM documents)
SELECT CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM b GROUP BY 1""",
    "seed_pick": f"""
SELECT p_partkey, CAST({_SEED.format("'plan|' || p_partkey")} AS DECIMAL(20,0)) AS seed, ['low', 'med', 'high'][CAST({_SEED.format("'plan|' || p_partkey")} % 3 AS INT) + 1] AS level,
  (CAST(('0x' || substr(sha256(p_name), 1, 8)) AS BIGINT) & 2147483647) % 1000 AS small FROM part""",
    "cyclic_plan": f"""
WITH s AS (SELECT DISTINCT scenario, ordinal FROM audit_sidecar WHERE ordinal IS NOT NULL),
o AS (SELECT *, ({_SEED.format("'7:' || scenario || ':narrative_form:0'")} % 6 + ordinal - 1) % 6 AS f, ({_SEED.format("'7:' || scenario || ':primary_dimension:0'")} % 5 + ordinal - 1) % 5 AS a,
  1 + ({_SEED.format("'7:' || scenario || ':secondary_dimension:0'")} % 4 + (ordinal - 1) // 5) % 4 AS step FROM s)
SELECT scenario, ordinal, {_SLUG.format("scenario")} || '-' || lpad(CAST(ordinal AS VARCHAR), 5, '0') AS id,
  ['direct', 'situation first', 'limits first', 'comparison', 'cautious', 'urgent'][CAST(f AS INT) + 1] AS form,
  ['budget', 'timing', 'access', 'upkeep', 'risk'][CAST(a AS INT) + 1] AS first_dim, ['budget', 'timing', 'access', 'upkeep', 'risk'][CAST((a + step) % 5 AS INT) + 1] AS second_dim FROM o""",
    "normalized_duplicates": f"SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS duplicate_excess FROM (SELECT {NORM.format("coalesce(text, '')")} AS n, count(*) AS k FROM documents GROUP BY 1) q",
    "text_measures": f"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS INT) AS ascii_words, CAST(len({_terms("text")}) AS INT) AS n_terms,
  CAST(CASE WHEN len(w) >= 5 THEN len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) WHEN w IS NOT NULL THEN 0 END AS INT) AS n_shingles, CAST(length(text) AS INT) AS chars FROM t""",
    "slug_categories": f"SELECT {_SLUG.format('subscenario')} AS slug, count(*) AS rows, count(DISTINCT subscenario) AS spellings FROM (SELECT subscenario FROM miu_record UNION ALL SELECT subscenario FROM eil_record) q GROUP BY 1",
    "boundary_cue_flags": f"SELECT DISTINCT id, lower({_cues_sql('user_natural_language', BOUNDARY_CUES)}) AS cue, lower({_cues_sql('user_natural_language', RELEASE_BOUNDARY_CUES)}) AS release_cue FROM eil_record",
    "tag_incidence": f"""
WITH f AS (SELECT family_domain, unnest(flatten({_NEC})) AS tag FROM eil_record)
SELECT '(all)' AS grp, tag, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT coalesce(family_domain, '(null)'), tag, count(*) FROM f GROUP BY family_domain, tag""",
    "attack_tagsets": f"""
SELECT coalesce(nullif(array_to_string(list_sort(list_distinct(flatten(list_transform(manipulated_context, lambda x: {_tags_sql("x.attack", ATTACK_TAGS)})))), '|'), ''), 'other') AS tagset, count(*) AS n FROM miu_record GROUP BY 1""",
    "distribution_entropy": "WITH" + _DIST.format(by="family_domain,", v="subscenario", t="miu_record", group="GROUP BY family_domain"),
    "event_distribution": "WITH" + _DIST.format(by="", v="event_type", t="events", group=""),
    "position_role_nmi": "WITH rows_ AS (SELECT CAST(i AS VARCHAR) AS l, CASE WHEN list_contains(list_transform(coalesce(clean_context, []), lambda c: c.content), external_information[i].content) THEN 'c' ELSE 'm' END AS r FROM miu_record, unnest(range(1, len(external_information) + 1)) u(i)),"
    + _NMI.format(by="", group="", out="", join=", a, b", places=6),
    "quantile_nearest_rank": """
WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL)
SELECT l_returnflag, round(max(CASE WHEN i = round_even((n - 1) * 0.5, 0) + 1 THEN v END), 4) AS p50, round(max(CASE WHEN i = round_even((n - 1) * 0.95, 0) + 1 THEN v END), 4) AS p95 FROM r GROUP BY 1""",
    "describe_by_group": """
SELECT l_returnflag, count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, round(quantile_cont(l_quantity, 0.25), 6) AS p25, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.75), 6) AS p75 FROM lineitem GROUP BY 1""",
    "spearman_ranks": """
WITH j AS (SELECT c_mktsegment, o_totalprice AS x, c_acctbal AS y FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY x) + (count(*) OVER (PARTITION BY c_mktsegment, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY c_mktsegment ORDER BY y) + (count(*) OVER (PARTITION BY c_mktsegment, y) - 1) / 2.0 AS ry FROM j)
SELECT c_mktsegment, count(*) AS n, round(corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)), 6) AS spearman FROM r GROUP BY 1""",
    "item_overlaps": f"""
WITH e AS (SELECT id, any_value(necessary_information) AS n, any_value(exploitable_slots) AS s FROM eil_record WHERE id IS NOT NULL GROUP BY id),
p AS (SELECT id, n[i] AS n, s[j] AS s FROM e, unnest(range(1, len(n) + 1)) u(i), unnest(range(1, len(s) + 1)) w(j)),
t AS (SELECT id, n.id AS nec, s.id AS slot, {_terms("n.content")} AS a, {_terms("s.content")} AS b FROM p)
SELECT id, nec, slot, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS overlap FROM t""",
    "miu_issue_counts": """
WITH m AS (SELECT *, coalesce(list_transform(clean_context, lambda c: c.id), []) AS cid, coalesce(list_transform(decision_boundary.options, lambda o: o.id), []) AS oid,
  list_sort(coalesce(list_transform(external_information, lambda e: e.content), [])) AS e,
  list_sort(list_concat(coalesce(list_transform(clean_context, lambda e: e.content), []), coalesce(list_transform(manipulated_context, lambda e: e.content), []))) AS h FROM miu_record),
i AS (SELECT 'option_set' AS code FROM m WHERE list_sort(oid) <> ['opt_1', 'opt_2', 'opt_3']
  UNION ALL SELECT 'visible_not_union' FROM m WHERE e <> h
  UNION ALL SELECT 'baseline_outside_closed_set' FROM m WHERE NOT coalesce(list_contains(oid, baseline_decision.decision), false)
  UNION ALL SELECT 'baseline_not_grounded' FROM m WHERE coalesce(len(baseline_decision.grounded_on), 0) < 1 OR len(list_filter(baseline_decision.grounded_on, lambda g: NOT list_contains(cid, g))) > 0)
SELECT code, 'hard' AS severity, count(*) AS n FROM i GROUP BY 1""",
    "provenance_checks": """
WITH ids AS (SELECT id FROM miu_record UNION SELECT id FROM eil_record),
j AS (SELECT ids.id, count(s.record_id) AS n, count(*) FILTER (WHERE s.record_id IS NOT NULL AND (s.prompt_sha256 IS NULL OR s.seed IS NULL)) AS bad FROM ids LEFT JOIN audit_sidecar s ON s.record_id = ids.id GROUP BY 1)
SELECT id AS record_id, CASE WHEN n = 0 THEN 'missing_audit_row' ELSE 'incomplete_audit_metadata' END AS code FROM j WHERE n = 0 OR bad > 0""",
    "latest_attempts": "SELECT record_id, max(attempt) AS latest, count(DISTINCT attempt) AS attempts, count(*) AS rows FROM audit_sidecar GROUP BY 1",
    "pending_records": "SELECT DISTINCT id FROM miu_record m WHERE NOT EXISTS (SELECT 1 FROM audit_sidecar s WHERE s.record_id = m.id)",
    "repeated_ids": "SELECT id, count(*) AS n FROM miu_record GROUP BY 1 HAVING count(*) > 1",
    "integrity_conflicts": f"""
WITH a AS (SELECT id, max({_SLUG.format("subscenario")}) AS s FROM miu_record WHERE id IS NOT NULL GROUP BY 1), b AS (SELECT record_id AS id, max({_SLUG.format("scenario")}) AS s FROM audit_sidecar GROUP BY 1),
j AS (SELECT CASE WHEN a.id IS NULL THEN 'missing' WHEN b.id IS NULL THEN 'unexpected' WHEN a.s IS DISTINCT FROM b.s THEN 'changed' END AS problem FROM a FULL JOIN b ON a.id = b.id)
SELECT problem, count(*) AS n FROM j WHERE problem IS NOT NULL GROUP BY 1""",
    "quarantine_counts": """
WITH m AS (SELECT id, coalesce(len(baseline_decision.grounded_on), 0) < 1 OR len(list_filter(baseline_decision.grounded_on, lambda g: NOT list_contains(coalesce(list_transform(clean_context, lambda c: c.id), []), g))) > 0 AS bad FROM miu_record),
b AS (SELECT DISTINCT id FROM m WHERE bad)
SELECT count(*) FILTER (WHERE id IN (SELECT id FROM b)) AS n, 'quarantined' AS part FROM m UNION ALL SELECT count(*) FILTER (WHERE id NOT IN (SELECT id FROM b)), 'retained' FROM m""",
    "pair_join": "SELECT p_brand, count(*) AS pairs, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "namespaced_union": """
WITH u AS (SELECT 'MIU:' || id AS id, split FROM (SELECT DISTINCT id, split FROM miu_record) q UNION ALL SELECT 'EIL:' || id, NULL FROM (SELECT DISTINCT id FROM eil_record) r)
SELECT regexp_extract(id, '^([A-Z]+):', 1) AS task, count(*) AS n, count(split) AS with_split FROM u GROUP BY 1""",
    "pilot_rows": f"""
WITH m AS (SELECT DISTINCT id, family_domain FROM miu_record WHERE id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY family_domain ORDER BY {_SEED.format("'pilot|' || id")}, id) AS k FROM m)
SELECT id, family_domain FROM r WHERE k <= 5""",
    "corpus_report": f"""
SELECT {_SLUG.format("family_domain")} AS family, count(*) AS records, count(DISTINCT lower(trim(split))) AS splits, coalesce(array_to_string(list_sort(list_distinct(list({_SLUG.format("subscenario")}))), '|'), '') AS scenarios FROM miu_record GROUP BY 1""",
    "option_positions": """
SELECT lower(trim(split)) AS split, count(*) FILTER (WHERE baseline_decision.decision = 'opt_1') AS opt_1, count(*) FILTER (WHERE baseline_decision.decision = 'opt_2') AS opt_2, count(*) FILTER (WHERE baseline_decision.decision = 'opt_3') AS opt_3 FROM miu_record GROUP BY 1""",
    "profile_nmi": f"""
WITH rows_ AS (SELECT family_domain, {_TAGSET.format(_NEC)} AS l, {_TAGSET.format("list_transform(exploitable_slots, lambda x: " + _tags_sql("x.content", LEVERAGE_TAGS) + ")")} AS r FROM eil_record),
""" + _NMI_FAMILY,
    "overlap_summary": f"""
WITH e AS (SELECT id, any_value(necessary_information) AS n, any_value(exploitable_slots) AS s FROM eil_record WHERE id IS NOT NULL GROUP BY id),
p AS (SELECT {_terms("n[i].content")} AS a, {_terms("s[j].content")} AS b FROM e, unnest(range(1, len(n) + 1)) u(i), unnest(range(1, len(s) + 1)) w(j)),
o AS (SELECT round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS o FROM p),
r AS (SELECT o, row_number() OVER (ORDER BY o) AS i, count(*) OVER () AS n FROM o WHERE o IS NOT NULL)
SELECT (SELECT count(*) FROM o) AS pairs, (SELECT round(avg(CASE WHEN o >= 0.58 THEN 1.0 WHEN o IS NOT NULL THEN 0.0 END), 6) FROM o) AS share_ge_058,
  round(max(CASE WHEN i = round_even((n - 1) * 0.5, 0) + 1 THEN o END), 4) AS median, round(max(CASE WHEN i = round_even((n - 1) * 0.95, 0) + 1 THEN o END), 4) AS p95 FROM r""",
    "anchor_copies": """
WITH l AS (SELECT record_id, max(attempt) AS a FROM audit_sidecar GROUP BY 1),
f AS (SELECT s.record_id, unnest(s.source_packet.facts) AS f FROM audit_sidecar s JOIN l ON s.record_id = l.record_id AND s.attempt IS NOT DISTINCT FROM l.a),
g AS (SELECT DISTINCT record_id, f.fact_id AS fact_id, regexp_extract_all(lower(f.source_anchor), '[a-z0-9]+') AS w FROM f),
m AS (SELECT DISTINCT id, regexp_extract_all(lower(user_natural_language), '[a-z0-9]+') AS v FROM miu_record)
SELECT DISTINCT record_id, fact_id FROM g JOIN m ON g.record_id = m.id
WHERE len(list_intersect(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')), list_transform(range(1, len(v) - 2), lambda i: array_to_string(v[i:i+3], ' ')))) > 0""",
    "earlier_similar_requests": """
WITH t AS (SELECT id, regexp_extract_all(lower(any_value(user_natural_language)), '[a-z0-9]+') AS w FROM miu_record WHERE id IS NOT NULL GROUP BY 1),
k AS (SELECT id, array_to_string(w[1:5], ' ') AS opening, w FROM t WHERE len(w) >= 5),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM k), n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.id, b.id AS earlier, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id > b.id GROUP BY ALL),
e AS (SELECT c.id, earlier FROM c JOIN n x ON x.id = c.id JOIN n y ON y.id = earlier WHERE c.c / (x.n + y.n - c.c) >= 0.48
  UNION ALL SELECT a.id, min(b.id) FROM k a JOIN k b ON a.opening = b.opening AND b.id < a.id GROUP BY 1)
SELECT id, min(earlier) AS earlier FROM e GROUP BY 1""",
    "sidecar_profile_mismatches": """
WITH m AS (SELECT id, any_value(meta) AS m FROM miu_record WHERE id IS NOT NULL GROUP BY 1), s AS (SELECT record_id, max_by(generation_profile, attempt) AS p FROM audit_sidecar GROUP BY 1)
SELECT record_id, unnest(list_filter([CASE WHEN m.num_clean <> p.record_plan.counts['num_clean'] THEN 'num_clean' END, CASE WHEN m.num_mani <> p.record_plan.counts['num_mani'] THEN 'num_mani' END], lambda x: x IS NOT NULL)) AS field FROM m JOIN s ON m.id = s.record_id""",
    "prompt_projection": """
WITH m AS (SELECT id, any_value(user_natural_language) AS u, any_value(decision_boundary) AS d, any_value(external_information) AS e FROM miu_record GROUP BY 1)
SELECT 'MIU:' || id AS record_id, 2 AS n, CAST(length(concat_ws(chr(10) || chr(10), u, 'Options:' || chr(10) || array_to_string(list_transform(d.options, lambda o, i: chr(CAST(64 + i AS INT)) || '. ' || coalesce(o.label, '')), chr(10)),
  'Information:' || chr(10) || array_to_string(list_transform(e, lambda x, i: '[E' || i || '] ' || coalesce(x.content, '')), chr(10)))) AS INT) AS chars FROM m""",
}
