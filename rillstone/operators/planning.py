"""Generation plans as pure columns: seeds, cyclic axes, source anchors, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions.hashing import cyclic_choice, hashed_pick, seed64
from rillstone.functions.text import shorten, slugify, strip_html


def plan_seed(base: int, scenario: str, ordinal: str) -> Column:
    return seed64(F.concat_ws(":", F.lit(str(base)), F.col(scenario), F.col(ordinal).cast("string")))


def axis_offset(base: int, scenario: str, axis: str, n: int) -> Column:
    """The stable start of an axis for a scenario."""
    return (seed64(F.concat(F.lit(f"{base}:"), F.col(scenario), F.lit(f":{axis}:0"))) % n).cast("long")


def axis_choice(base: int, scenario: str, ordinal: str, values: list[str], axis: str) -> Column:
    """A value of an axis: every value in turn, from the axis's start."""
    return cyclic_choice(values, axis_offset(base, scenario, axis, len(values)), F.col(ordinal))


def paired_choice(base: int, scenario: str, ordinal: str, values: list[str]) -> Column:
    """Two different values: the first in turn, the second at a step that advances once per full turn."""
    n = len(values)
    first = ((axis_offset(base, scenario, "primary_dimension", n) + F.col(ordinal) - 1) % n).cast("int")
    turn = F.floor((F.col(ordinal) - 1) / n)
    step = 1 + (seed64(F.concat(F.lit(f"{base}:"), F.col(scenario), F.lit(":secondary_dimension:0"))) + turn) % (n - 1)
    second = ((first + step) % n).cast("int")
    arr = F.array(*map(F.lit, values))
    return F.array(F.element_at(arr, first + 1), F.element_at(arr, second + 1))


def record_id(scenario: str, ordinal: str) -> Column:
    return F.concat(slugify(scenario), F.lit("-"), F.lpad(F.col(ordinal).cast("string"), 5, "0"))


def scenario_plan(scenarios: DataFrame, base: int, axes: dict[str, list[str]], count: str = "target_count") -> DataFrame:
    """One row per scenario and ordinal with id, seed and a value of each axis."""
    rows = scenarios.select("*", F.explode(F.sequence(F.lit(1), F.col(count))).alias("ordinal"))
    chosen = [axis_choice(base, "scenario", "ordinal", v, a).alias(a) for a, v in axes.items()]
    return rows.select("*", record_id("scenario", "ordinal").alias("id"), plan_seed(base, "scenario", "ordinal").alias("seed"), *chosen)


# --- source anchors: each extractor gives `name=value; ...` text and where it came from ----


def field_text(fields: dict[str, Column]) -> Column:
    """"name=value" of the fields that have one, joined by "; "."""
    return F.array_join(F.array_compact(F.array(*[F.when(v.isNotNull() & (F.trim(v.cast("string")) != ""), F.concat(F.lit(f"{n}="), v.cast("string"))) for n, v in fields.items()])), "; ")


def anchors(rows: DataFrame, dataset: str, file: Column, locator: Column, fields: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Source facts: (dataset, file, locator, fields, source_anchor), anchors shortened, empty ones left out."""
    kept = rows if where is None else rows.where(where)
    out = kept.select(F.lit(dataset).alias("dataset"), file.alias("file"), locator.cast("string").alias("locator"), F.array(*map(F.lit, fields)).alias("fields"), field_text(fields).alias("t"))
    return out.where("t != ''").select("dataset", "file", "locator", "fields", shorten("t").alias("source_anchor"))


def unnested(rows: DataFrame, path: list[str]) -> DataFrame:
    """Explode nested arrays one after the other; the innermost elements come as `item`."""
    out = rows.withColumn("item", F.explode(path[0]))
    for p in path[1:]:
        out = out.withColumn("item", F.explode(F.col("item")[p]))
    return out


def tag_sections(c: Column | str, tag: str, drop_tags: bool = True) -> Column:
    """Bodies of each <tag> element of XML or HTML text, inner tags stripped."""
    found = F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, lambda x: strip_html(x, 1 << 20)) if drop_tags else found


def element_map(c: Column | str) -> Column:
    """Leaf elements of flat XML as map<name,text>; the last of a name stands."""
    c = F.col(c) if isinstance(c, str) else c
    names, values = (F.regexp_extract_all(c, F.lit(r"<([A-Za-z0-9_]+)>([^<]*)</\1>"), F.lit(i)) for i in (1, 2))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


def literal_prompts(c: Column | str, name: str = "PROMPT", risky: str = r"(?i)password|credential|iban|transfer") -> Column:
    """Quoted literals assigned to NAME in source text, risky ones redacted."""
    c = F.col(c) if isinstance(c, str) else c
    found = F.regexp_extract_all(c, F.lit(rf'(?s){name}\s*=\s*(?:f?)("""|")(.*?)\1'), F.lit(2))
    return F.transform(found, lambda x: F.when(x.rlike(risky), "[redacted]").otherwise(x))


def seeded_facts(plan: DataFrame, facts: DataFrame, per_record: int = 1) -> DataFrame:
    """Give each planned record facts of its dataset by seed: numbered facts joined on seed mod count.

    plan: id, dataset, seed; facts: dataset, n (0-based within the dataset), source_anchor ...
    """
    sizes = facts.groupBy("dataset").agg(F.count(F.lit(1)).alias("__size"))
    wanted = plan.join(sizes, "dataset").select("*", F.explode(F.sequence(F.lit(0), F.lit(per_record - 1))).alias("__i"))
    wanted = wanted.withColumn("n", ((F.col("seed") + F.col("__i")) % F.col("__size")).cast("long"))
    return wanted.join(facts, ["dataset", "n"]).withColumn("fact_id", F.concat(F.lit("src_"), (F.col("__i") + 1).cast("string"))).drop("__size", "__i", "n")


def picked(values: str, seed: str) -> Column:
    return hashed_pick(F.col(values), F.col(seed))


# --- prompts ------------------------------------------------------------------------------


def lettered(items: Column, field: str) -> Column:
    """"A. text" lines of an array of structs."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), F.coalesce(x[field], F.lit("")))), "\n")


def cards(items: Column, field: str = "content") -> Column:
    """"[E1] text" lines of an array of structs."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("[E"), (i + 1).cast("string"), F.lit("] "), F.coalesce(x[field], F.lit("")))), "\n")


def decision_messages(system: str) -> Column:
    """Chat messages of a decision record: request, lettered options, numbered cards."""
    user = F.concat_ws("\n\n", "user_natural_language", F.concat(F.lit("Options:\n"), lettered(F.col("decision_boundary.options"), "label")), F.concat(F.lit("Information:\n"), cards(F.col("external_information"))))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def exchange_messages(system: str) -> Column:
    """Chat messages of a negotiation record: the briefing and the counterparty's opening."""
    user = F.concat_ws("\n\n", F.concat(F.lit("Briefing:\n"), "user_natural_language"), F.concat(F.lit("Counterparty:\n"), "adversary_opening"))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def with_instruction(messages: Column, instruction: str) -> Column:
    """Messages with a fixed instruction added to the system message."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "system", F.concat(m["content"], F.lit("\n\n" + instruction))).otherwise(m["content"]).alias("content")))


def kept_roles(messages: Column, roles: tuple[str, ...] = ("system", "user", "assistant", "tool")) -> Column:
    """Messages as role and content alone; null where a role is unknown."""
    plain = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return F.when(F.forall(messages, lambda m: F.coalesce(m["role"].isin(*roles), F.lit(False))), plain)
