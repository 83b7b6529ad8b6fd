"""The p5_ queries: nested MIU records as flat tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators.nested import ENVELOPES, MIU_TABLES, RECORD_MARKS, WRAPPERS, child_rows, flat_tables
from rillstone.sources.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return child_rows(table(spark, d, "miu_raw"))


def p5_cards(spark: SparkSession, d: str) -> DataFrame:
    tables = flat_tables(table(spark, d, "miu_raw"))
    one, two = tables["clean_context"], tables["manipulated_context"]
    return one.select("raw_id", F.lit("clean").alias("kind"), "child_ref", "content", "dataset", "locator").unionAll(two.select("raw_id", F.lit("manipulated"), "child_ref", "content", "dataset", "locator"))


def p5_constraints(spark: SparkSession, d: str) -> DataFrame:
    tables = flat_tables(table(spark, d, "miu_raw"))
    rows, evidence = tables["per_constraint"], tables["per_constraint.evidence"]
    cited = evidence.groupBy("raw_id", F.slice("ordinals", 1, 1).alias("ordinals")).agg(F.count(F.lit(1)).alias("n_evidence"))
    return rows.join(cited, ["raw_id", "ordinals"], "left").select("raw_id", "child_ref", "status", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return flat_tables(table(spark, d, "miu_raw"))["record"].drop("ordinals", "parent_ref", "child_ref", "other")


def p5_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every table the payloads make, with its rows and its leaves beside the named columns."""
    parts = [t.select(F.lit(n).alias("child_table"), F.size("other").alias("others")) for n, t in flat_tables(table(spark, d, "miu_raw"), found=True).items()]
    return reduce(DataFrame.unionAll, parts).groupBy("child_table").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("others").alias("other_leaves"))


def p5_typed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Child rows of the typed records: the arrays are exploded in place, without Python."""
    miu = table(spark, d, "miu_record", "id", "decision_boundary", "clean_context", "manipulated_context", "baseline_decision")

    def part(name: str, column: str, ref: str) -> DataFrame:
        rows = miu.select("id", F.posexplode(column).alias("pos", "one")).where("one is not null")
        own = F.col(ref)
        return rows.select("id", F.lit(name).alias("child_table"), F.coalesce(own, F.concat(F.lit("#"), (F.col("pos") + 1).cast("string"))).alias("child_ref"))

    parts = [part("options", "decision_boundary.options", "one.id"), part("clean_context", "clean_context", "one.id"), part("manipulated_context", "manipulated_context", "one.id"), part("grounded_on", "baseline_decision.grounded_on", "one")]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole.groupBy("id", "child_table", "child_ref").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {f.__name__: f for f in (p5_found, p5_cards, p5_constraints, p5_records, p5_tables, p5_typed_rows)}

def _decoded_sql(e: str, times: int = 2) -> str:
    """JSON text inside JSON text, read a few times over; other text stays."""
    for _ in range(times):
        e = f"list_transform([{e}], lambda x: CASE WHEN json_type(x) = 'VARCHAR' AND json_type(TRY_CAST(x ->> '$' AS JSON)) IN ('OBJECT', 'ARRAY', 'VARCHAR') THEN TRY_CAST(x ->> '$' AS JSON) ELSE x END)[1]"
    return e


def _has_sql(e: str, keys: tuple[str, ...]) -> str:
    return " OR ".join(f"json_exists({e}, '$.{k}')" for k in keys)


def _first_sql(e: str, keys: tuple[str, ...], kinds: str) -> str:
    """The value of the first of the keys that is of one of the kinds."""
    cases = [f"CASE WHEN json_type({_decoded_sql(f'({e} -> {key})', 1)}) IN ({kinds}) THEN {e} -> {key} END" for key in (f"'$.{k}'" for k in keys)]
    return "coalesce(" + ", ".join(cases) + ")"


#: The record of each readable payload, out of its envelopes and encodings.
_RECORDS = f"""
RECURSIVE u AS (
  SELECT raw_id, TRY_CAST(payload AS JSON) AS j, 0 AS k FROM miu_raw
  UNION ALL SELECT raw_id, next, k + 1 FROM (
    SELECT raw_id, k, CASE json_type(j) WHEN 'VARCHAR' THEN TRY_CAST(j ->> '$' AS JSON) WHEN 'ARRAY' THEN CASE WHEN json_array_length(j) = 1 THEN j -> 0 END
      WHEN 'OBJECT' THEN CASE WHEN NOT ({_has_sql("j", RECORD_MARKS)}) THEN {_first_sql("j", ENVELOPES, "'OBJECT', 'ARRAY', 'VARCHAR'")} END END AS next FROM u WHERE j IS NOT NULL) q WHERE next IS NOT NULL),
r AS (SELECT raw_id, j FROM (SELECT raw_id, arg_max(j, k) AS j FROM u WHERE j IS NOT NULL GROUP BY 1) q WHERE json_type(j) = 'OBJECT')"""


#: A member by its key k.
_KEYED = "json_extract({0}, '/' || replace(replace(k, '~', '~0'), '/', '~1'))"


def _leaf_sql(e: str, path: str) -> str:
    return f"CASE WHEN json_type({e}, '$.{path}') NOT IN ('OBJECT', 'ARRAY') THEN {e} ->> '$.{path}' END"


def _list_sql(rows: str, path: tuple[str, ...], marks: tuple[str, ...]) -> str:
    """(raw_id, parent_ref, child_ref, v): the elements of a list below each row (raw_id, ref, v), in any of its shapes: a
    list, a wrapper with a single key, an object keyed by ids, one element; also where its wrapper should stand."""
    marked = lambda e: f"({_has_sql(e, marks)})" if marks else "false"
    spot = f"(v -> '$.{path[0]}')"
    for step in path[1:]:
        x = _decoded_sql(spot)
        any_marked = f"len(list_filter(json_keys({x}), lambda k: {marked(_decoded_sql(_KEYED.format(x), 1))})) > 0"
        spot = f"(CASE json_type({x}) WHEN 'ARRAY' THEN {x} WHEN 'OBJECT' THEN CASE WHEN json_exists({x}, '$.{step}') THEN {x} -> '$.{step}' WHEN {any_marked} THEN {x} END END)"
    inner, one = _first_sql("c", WRAPPERS, "'OBJECT', 'ARRAY', 'VARCHAR'"), _decoded_sql("w", 1)
    return f"""SELECT raw_id, ref AS parent_ref, coalesce(key, nullif(CASE WHEN json_type(v) = 'OBJECT' THEN v ->> '$.id' ELSE v ->> '$' END, ''), '#' || nth) AS child_ref, v
FROM (SELECT raw_id, ref, e.nth AS nth, e.key AS key, {_decoded_sql("e.one")} AS v FROM (SELECT raw_id, ref, unnest(CASE json_type(c)
    WHEN 'ARRAY' THEN list_transform(range(1, CAST(json_array_length(c) AS BIGINT) + 1), lambda i: struct_pack(nth := i, key := CAST(NULL AS VARCHAR), one := json_extract(c, '$[' || (i - 1) || ']')))
    WHEN 'OBJECT' THEN CASE WHEN json_exists(c, '$.id') OR {marked("c")} THEN [struct_pack(nth := CAST(1 AS BIGINT), key := CAST(NULL AS VARCHAR), one := c)]
      ELSE list_transform(json_keys(c), lambda k, i: struct_pack(nth := CAST(i AS BIGINT), key := k, one := {_KEYED.format("c")})) END
    WHEN 'NULL' THEN [] ELSE [struct_pack(nth := CAST(1 AS BIGINT), key := CAST(NULL AS VARCHAR), one := c)] END) AS e
  FROM (SELECT raw_id, ref, CASE WHEN json_type(c) = 'OBJECT' AND len(json_keys(c)) = 1 AND w IS NOT NULL AND NOT (json_exists(c, '$.id') OR {marked("c")}) AND NOT (json_type({one}) = 'OBJECT' AND {marked(one)}) THEN {one} ELSE c END AS c
    FROM (SELECT *, {inner} AS w FROM (SELECT raw_id, ref, {_decoded_sql("spot")} AS c FROM (SELECT raw_id, ref, {spot} AS spot FROM {rows}) q1) q0) q WHERE c IS NOT NULL) q2) x) y WHERE json_type(v) <> 'NULL'"""


def _tables_sql() -> tuple[str, str]:
    """The child tables as named queries over the records, and their union."""
    named, union, rest = [f"{_RECORDS}", "top AS (SELECT raw_id, '' AS ref, j AS v FROM r)"], [], [("top", t) for t in MIU_TABLES]
    while rest:
        above, t = rest.pop(0)
        own = "t_" + t.name.replace(".", "_")
        named += [f"{own} AS ({_list_sql(above, t.path, t.marks)})", f"{own}_rows AS (SELECT raw_id, child_ref AS ref, v FROM {own})"]
        union.append(f"SELECT raw_id, '{t.name}' AS child_table, parent_ref, child_ref FROM {own}")
        rest += [(f"{own}_rows", b) for b in t.below]
    return ",\n".join(named), "\nUNION ALL ".join(union)


_NAMED, _UNION = _tables_sql()


def _cards_sql(part: str, kind: str) -> str:
    return f"SELECT raw_id, '{kind}' AS kind, child_ref, {_leaf_sql('v', 'content')} AS content, {_leaf_sql('v', 'provenance.source_ref.dataset')} AS dataset, {_leaf_sql('v', 'provenance.source_ref.locator')} AS locator FROM t_{part}"


_BASELINE = _decoded_sql("(j -> '$.baseline_decision')")

ORACLES = {
    "p5_records": f"""WITH {_RECORDS}, b AS (SELECT *, {_BASELINE} AS b FROM r)
SELECT raw_id, """
    + ", ".join(f"{_leaf_sql('j', c)} AS {c}" for c in ("id", "mechanism", "family_domain", "subscenario", "split"))
    + f""", {_leaf_sql("b", "decision")} AS decision, {_leaf_sql("b", "conclusion")} AS conclusion FROM b""",
    "p5_cards": f"WITH {_NAMED} {_cards_sql('clean_context', 'clean')} UNION ALL {_cards_sql('manipulated_context', 'manipulated')}",
    "p5_found": f"WITH {_NAMED} {_UNION}",
    # The constraints of one record have different references in these tables.
    "p5_constraints": f"""WITH {_NAMED}, n AS (SELECT raw_id, parent_ref, count(*) AS n FROM t_per_constraint_evidence GROUP BY 1, 2)
SELECT c.raw_id, c.child_ref, {_leaf_sql("c.v", "status")} AS status, coalesce(n.n, 0) AS n_evidence FROM t_per_constraint c LEFT JOIN n ON n.raw_id = c.raw_id AND n.parent_ref = c.child_ref""",
    "p5_typed_rows": """
WITH u AS (
  SELECT id, 'options' AS child_table, i AS pos, decision_boundary.options[i].id AS ref, decision_boundary.options[i] IS NULL AS gone
  FROM miu_record, UNNEST(range(1, len(decision_boundary.options) + 1)) AS t(i)
  UNION ALL SELECT id, 'clean_context', i, clean_context[i].id, clean_context[i] IS NULL FROM miu_record, UNNEST(range(1, len(clean_context) + 1)) AS t(i)
  UNION ALL SELECT id, 'manipulated_context', i, manipulated_context[i].id, manipulated_context[i] IS NULL FROM miu_record, UNNEST(range(1, len(manipulated_context) + 1)) AS t(i)
  UNION ALL SELECT id, 'grounded_on', i, baseline_decision.grounded_on[i], baseline_decision.grounded_on[i] IS NULL FROM miu_record, UNNEST(range(1, len(baseline_decision.grounded_on) + 1)) AS t(i))
SELECT id, child_table, coalesce(ref, '#' || CAST(pos AS VARCHAR)) AS child_ref, count(*) AS n_rows FROM u WHERE NOT gone GROUP BY 1, 2, 3""",
}
