"""Record validators as issue arrays, corpus gates, and dependence diagnostics.

A rule is data: a code, a severity and a column that is true where the record breaks it (or an
array of details). All rules of a record are evaluated in one pass without a shuffle; every
violation is kept, not only the first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions import stats, text
from rillstone.functions.taxonomies import ATTACK_TAGS, AUTHORITY_TAGS, LEVERAGE_TAGS, NECESSARY_TAGS, RELEASE_BOUNDARY_CUES


@dataclass(frozen=True)
class Rule:
    """details: array<string>, one element per violation, or a boolean column."""

    code: str
    severity: str
    details: Column
    boolean: bool = True

    def found(self) -> Column:
        d = F.when(self.details, F.array(F.lit(""))) if self.boolean else self.details
        d = F.coalesce(d, F.array().cast("array<string>"))
        return F.transform(d, lambda x: F.struct(F.lit(self.code).alias("code"), F.lit(self.severity).alias("severity"), x.alias("detail")))


def issues(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(key, code, severity, detail), one row per violation."""
    return df.select(F.col(key).alias("record_id"), F.explode(F.flatten(F.array(*[r.found() for r in rules]))).alias("i")).select("record_id", "i.*")


def quarantine_ids(found: DataFrame, warnings: tuple[str, ...] = ()) -> DataFrame:
    """(record_id): records with a hard error of any rule, and those with one of the named warnings."""
    return found.where((F.col("severity") == "hard") | F.col("code").isin(*warnings)).select("record_id").distinct()


def _ids(items: str, prefix: str) -> Column:
    """Items whose id is not prefix_i in their order."""
    bad = F.transform(items, lambda x, i: F.when(~x["id"].eqNullSafe(F.concat(F.lit(prefix + "_"), (i + 1).cast("string"))), F.coalesce(x["id"], F.lit("(null)"))))
    return F.array_compact(bad)


def word_bounds(items: str, field: str, least: int, most: int) -> Column:
    """Ids of items whose text has fewer or more words."""
    n = lambda x: text.words(x[field])
    return F.transform(F.filter(items, lambda x: x[field].isNull() | (n(x) < least) | (n(x) > most)), lambda x: F.coalesce(x["id"], F.lit("(null)")))


def _pair_overlaps(left: Column, right: Column, least: float, ordered: bool = False) -> Column:
    """"a~b" for each pair of items whose terms overlap by at least `least`; terms are made once per item."""
    termed = lambda arr: F.transform(arr, lambda x, i: F.struct(i.alias("i"), x["id"].alias("id"), text.terms(x["content"]).alias("t")))

    def row(a: Column, others: Column) -> Column:
        hit = F.filter(others, lambda b: (text.jaccard(a["t"], b["t"]) >= least) & ((a["i"] < b["i"]) if ordered else F.lit(True)))
        return F.transform(hit, lambda b: F.concat_ws("~", a["id"], b["id"]))

    return text.let(termed(right), lambda others: F.flatten(F.transform(termed(left), lambda a: row(a, others))))


def eil_rules() -> list[Rule]:
    c = F.col
    opening = F.array(F.struct(F.lit("opening").alias("id"), F.coalesce(c("adversary_opening"), F.lit("")).alias("content")))
    tactics = c("adversary_config.tactics")
    return [
        Rule("wrong_mechanism", "hard", ~F.coalesce(F.upper(F.trim("mechanism")) == "EIL", F.lit(False))),
        Rule("missing_field", "hard", F.array_compact(F.array(*[F.when(c(f).isNull(), f) for f in ("id", "family_domain", "subscenario", "split", "user_natural_language", "adversary_opening", "necessary_information", "exploitable_slots", "adversary_config")])), False),
        Rule("privacy_boundary_leak", "hard", F.array_compact(F.array(text.first_cue("user_natural_language", RELEASE_BOUNDARY_CUES))), False),
        Rule("necessary_ids", "hard", _ids("necessary_information", "nec"), False),
        Rule("slot_ids", "hard", _ids("exploitable_slots", "exp"), False),
        Rule("severity_domain", "hard", F.transform(F.filter("exploitable_slots", lambda x: ~F.coalesce(x["severity"].isin("low", "med", "high"), F.lit(False))), lambda x: x["id"]), False),
        Rule("item_count", "hard", ~F.size("necessary_information").between(1, 5) | ~F.size("exploitable_slots").between(1, 5)),
        Rule("necessary_slot_overlap", "hard", _pair_overlaps(c("necessary_information"), c("exploitable_slots"), 0.58), False),
        Rule("slot_near_duplicate", "warning", _pair_overlaps(c("exploitable_slots"), c("exploitable_slots"), 0.72, True), False),
        Rule("opening_repeats_hidden_slot", "warning", _pair_overlaps(opening, c("exploitable_slots"), 0.70), False),
        Rule("invalid_adversary_tactics", "hard", F.coalesce((F.size(tactics) < 1) | (F.size(F.array_distinct(tactics)) != F.size(tactics)), F.lit(True))),
        Rule("invalid_adversary_pressure", "hard", ~F.coalesce(c("adversary_config.pressure").isin("low", "med", "high"), F.lit(False))),
        Rule("count_mismatch", "warning", (F.size("necessary_information") != c("meta.num_nec")) | (F.size("exploitable_slots") != c("meta.num_exp"))),
    ]


#: Names of the pipeline that a request must not show.
PIPELINE_LABELS = r"(?i)\bbaseline decision\b|\bclean (?:context|card)\b|\bmanipulated (?:context|card|material)\b|\bjson\b|\bschema\b|\b(?:auth|con|pref|opt)_\d+\b"


def miu_rules() -> list[Rule]:
    c = F.col
    options, clean, mani, ext = c("decision_boundary.options"), c("clean_context"), c("manipulated_context"), c("external_information")
    none = F.array().cast("array<string>")
    ids = lambda a: F.coalesce(F.transform(a, lambda x: x["id"]), none)
    contents = lambda a: F.coalesce(F.transform(a, lambda x: x["content"]), none)
    labels = F.transform(options, lambda o: text.normalized(o["label"]))
    cited = c("baseline_decision.grounded_on")
    mean_words = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(F.size(F.regexp_extract_all(x["content"], F.lit(r"(?U)\w+"), F.lit(0))), F.lit(0))) / F.size(a))
    soft = ("prefer", "ideally", "would like", "nice to have")
    firm = r"(?i)\b(?:must|require|only|cannot|mandatory|non-negotiable)\b"
    named = F.exists(mani, lambda m: F.exists(options, lambda o: (o["id"] == c("baseline_decision.decision")) & (text.normalized(o["label"]) != "") & F.contains(text.normalized(m["content"]), text.normalized(o["label"]))))
    return [
        Rule("wrong_mechanism", "hard", ~F.coalesce(F.upper(F.trim("mechanism")) == "MIU", F.lit(False))),
        Rule("missing_field", "hard", F.array_compact(F.array(*[F.when(c(f).isNull(), f) for f in ("id", "family_domain", "subscenario", "split", "user_natural_language", "decision_boundary", "clean_context", "manipulated_context", "external_information", "baseline_decision")])), False),
        Rule("option_set", "hard", F.coalesce(F.array_sort(ids(options)) != F.array(F.lit("opt_1"), F.lit("opt_2"), F.lit("opt_3")), F.lit(True))),
        Rule("option_labels", "hard", F.coalesce((F.size(F.array_distinct(labels)) != F.size(labels)) | F.array_contains(labels, ""), F.lit(True))),
        Rule("visible_not_union", "hard", F.array_sort(contents(ext)) != F.array_sort(F.concat(contents(clean), contents(mani)))),
        Rule("baseline_outside_closed_set", "hard", ~F.coalesce(F.array_contains(ids(options), c("baseline_decision.decision")), F.lit(False))),
        Rule("baseline_not_grounded", "hard", F.coalesce((F.size(cited) < 1) | (F.size(F.array_except(cited, ids(clean))) > 0), F.lit(True))),
        Rule("clean_context_unauthorized", "hard", F.array_except(F.coalesce(F.transform(clean, lambda x: F.coalesce(x["authorized_by"], F.lit("(null)"))), none), ids(c("authorized_information"))), False),
        Rule("clean_ids", "hard", _ids("clean_context", "clean"), False),
        Rule("manipulated_ids", "hard", _ids("manipulated_context", "mani"), False),
        Rule("pipeline_label_leak", "hard", c("user_natural_language").rlike(PIPELINE_LABELS)),
        Rule("constraint_preference_mixing", "hard", F.transform(F.filter("user_constraints", lambda x: F.lower(x["content"]).rlike("|".join(soft))), lambda x: x["id"]), False),
        Rule("preference_constraint_mixing", "hard", F.transform(F.filter("user_preferences", lambda x: x["content"].rlike(firm)), lambda x: x["id"]), False),
        Rule("attack_mentions_baseline", "warning", named),
        Rule("duplicate_attack_labels", "hard", F.size(F.array_distinct(F.transform(mani, lambda m: text.normalized(m["attack"])))) != F.size(mani)),
        Rule("length_cue", "warning", F.abs(mean_words(clean) - mean_words(mani)) > 9),
        Rule("count_mismatch", "warning", (F.size(clean) != c("meta.num_clean")) | (F.size(mani) != c("meta.num_mani"))),
    ]


def anchor_copies(records: DataFrame, sidecar: DataFrame, field: str, n: int = 16) -> DataFrame:
    """(record_id, fact_id) where a record's text shares n consecutive words with a source anchor of its latest sidecar."""
    latest = sidecar.groupBy(F.col("record_id").alias("rid")).agg(F.max("attempt").alias("latest"))
    facts = sidecar.join(latest, (F.col("record_id") == F.col("rid")) & F.col("attempt").eqNullSafe(F.col("latest"))).select("record_id", F.explode("source_packet.facts").alias("f"))
    both = facts.select("record_id", "f.fact_id", "f.source_anchor").join(records.select("id", field), F.col("record_id") == F.col("id"))
    return both.where(text.shares_ngram(field, "source_anchor", n)).select("record_id", "fact_id").distinct()


def provenance_issues(records: DataFrame, sidecar: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(record_id, code): records without a sidecar, without prompt hash or seed, and (with files: file,
    sha256) whose cited file is missing or has another checksum."""
    ids = records.select("id").distinct()
    joined = ids.join(sidecar, F.col("id") == F.col("record_id"), "left")
    basic = joined.groupBy("id").agg(F.count("record_id").alias("n"), F.count_if(F.col("record_id").isNotNull() & (F.col("prompt_sha256").isNull() | F.col("seed").isNull())).alias("bad"))
    found = basic.select(F.col("id").alias("record_id"), F.when(F.col("n") == 0, "missing_audit_row").when(F.col("bad") > 0, "incomplete_audit_metadata").alias("code")).where("code is not null")
    if files is None:
        return found
    refs = joined.where("record_id is not null").select("id", F.explode("source_packet.facts.source_ref").alias("r")).where("r is not null").select("id", "r.file", "r.sha256").distinct()
    held = refs.join(files.select(F.col("file").alias("f"), F.col("sha256").alias("actual")), F.col("file") == F.col("f"), "left")
    wrong = F.when(F.col("f").isNull(), "missing_provenance_source").when(~F.col("sha256").eqNullSafe(F.col("actual")), "provenance_checksum_mismatch")
    return found.unionAll(held.select(F.col("id"), wrong.alias("code")).where("code is not null").distinct())


def profile_mismatches(records: DataFrame, sidecar: DataFrame, key: str, counted: dict[str, str]) -> DataFrame:
    """(record_id, field): meta counts that differ from the latest sidecar plan's counts, where the plan has them."""
    latest = sidecar.groupBy("record_id").agg(F.max_by("generation_profile", "attempt").alias("p"))
    both = records.join(latest, F.col(key) == F.col("record_id"))
    bad = F.array_compact(F.array(*[F.when(F.col(f"meta.{m}") != F.try_element_at("p.record_plan.counts", F.lit(p)), m) for m, p in counted.items()]))
    return both.select("record_id", F.explode(bad).alias("field"))


def release_gate(found: DataFrame, records: DataFrame, request: str) -> DataFrame:
    """One row: records, hard errors, warnings, duplicate requests, and pass or fail."""
    n = found.agg(F.count_if(F.col("severity") == "hard").alias("hard"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    excess = stats.duplicate_excess(records, text.normalized(F.coalesce(request, F.lit(""))), "duplicate_requests")
    size = records.agg(F.count(F.lit(1)).alias("records"))
    # One row each.
    return size.join(F.broadcast(n)).join(F.broadcast(excess)).withColumn("gate", F.when((F.col("hard") == 0) & (F.col("duplicate_requests") == 0), "pass").otherwise("fail"))


def eil_profiles(eil: DataFrame) -> DataFrame:
    """(id, family_domain, left, right): tag sets of what may be told and of what must not."""
    lists = lambda c, rules: text.tagset(F.transform(c, lambda x: text.tags(x["content"], rules)))
    return eil.select("id", "family_domain", lists("necessary_information", NECESSARY_TAGS).alias("left"), lists("exploitable_slots", LEVERAGE_TAGS).alias("right"))


def miu_profiles(miu: DataFrame) -> DataFrame:
    """(id, family_domain, left, right): tag sets of the clean cards' authorities and of the attacks."""
    names = F.map_from_entries(F.transform(F.array_distinct(F.coalesce(F.transform("authorized_information", lambda a: F.struct(a["id"], a["name"])), F.array().cast("array<struct<id:string,name:string>>"))), lambda a: a))
    authority = text.tagset(F.transform("clean_context", lambda c: text.tags(F.try_element_at(names, c["authorized_by"]), AUTHORITY_TAGS)))
    attack = text.tagset(F.transform("manipulated_context", lambda m: text.tags(m["attack"], ATTACK_TAGS)))
    return miu.select("id", "family_domain", authority.alias("left"), attack.alias("right"))


def conditional_nmi(profiles: DataFrame, family: str = "family_domain") -> DataFrame:
    """NMI of left and right within each family, to 4 places."""
    n = stats.nmi(profiles, "left", "right", [family])
    return n.select(family, "records", F.bround("nmi", 4).alias("nmi"))


def position_roles(miu: DataFrame) -> DataFrame:
    """Displayed position and hidden role of each visible card, for the position leak."""
    clean = F.coalesce(F.transform("clean_context", lambda c: c["content"]), F.array().cast("array<string>"))
    return miu.select("id", clean.alias("clean"), F.posexplode("external_information").alias("pos", "x")).select("id", F.col("pos").cast("string").alias("left"), F.when(F.array_contains("clean", F.col("x.content")), "clean").otherwise("manipulated").alias("right"))
