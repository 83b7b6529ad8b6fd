"""The strict decision protocol and claim tables, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions.taxonomies import SUPPORT_BOUNDS
from rillstone.functions.text import let, strip_thinking


def parsed_decision(response: Column | str, options: int = 3, cards: Column | None = None) -> Column:
    """struct(letter, reasons array<struct<claim, citations>>, problem) of "Decision: X" and 1-4 cited "Reason:" lines.

    problem is null for a valid response, else the first rule it breaks. Citations are in order,
    each once; with cards, a citation beyond that number is a problem.
    """
    lines = F.filter(F.transform(F.split(strip_thinking(response), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    last = chr(64 + options)

    def reason(x: Column) -> Column:
        cited = F.array_distinct(F.regexp_extract_all(x, F.lit(r"\[E(\d+)\]"), F.lit(1)))
        claim = F.trim(F.regexp_replace(F.regexp_replace(x, r"^Reason:\s*", ""), r"\s*\[E\d+\]", ""))
        return F.struct(claim.alias("claim"), F.transform(cited, lambda c: c.cast("int")).alias("citations"))

    def judged(plain: Column) -> Column:
        letter = F.nullif(F.regexp_extract(F.coalesce(F.try_element_at(plain, F.lit(1)), F.lit("")), rf"^Decision: ([A-{last}])$", 1), F.lit(""))
        rest = F.slice(plain, 2, 1 << 30)
        return let(F.transform(rest, reason), lambda reasons: outcome(letter, rest, reasons))

    def outcome(letter: Column, rest: Column, reasons: Column) -> Column:
        beyond = F.exists(reasons, lambda r: F.exists(r["citations"], lambda c: c > cards)) if cards is not None else F.lit(False)
        problem = (
            F.when(letter.isNull(), "no_decision_line").when(F.size(rest) < 1, "no_reason").when(F.size(rest) > 4, "too_many_reasons")
            .when(F.exists(rest, lambda x: ~x.startswith("Reason: ")), "unexpected_line").when(F.exists(reasons, lambda r: F.size(r["citations"]) < 1), "uncited_reason")
            .when(F.exists(reasons, lambda r: r["claim"] == ""), "empty_reason").when(beyond, "unknown_citation")
        )
        return F.struct(letter.alias("letter"), reasons.alias("reasons"), problem.alias("problem"))

    return let(F.transform(lines, lambda x: F.regexp_replace(x, r"^\*\*(.*)\*\*$", "$1")), judged)


def exact_match(chosen: Column, reference: Column) -> Column:
    return F.coalesce((chosen == reference).cast("double"), F.lit(0.0))


def claim_issues(claims: Column) -> Column:
    """Problems of array<struct<reason_id, status, support_score>>: statuses outside the table, supports outside the status's bounds."""
    low = F.create_map(*[x for k, (a, _) in SUPPORT_BOUNDS.items() for x in (F.lit(k), F.lit(a))])
    high = F.create_map(*[x for k, (_, b) in SUPPORT_BOUNDS.items() for x in (F.lit(k), F.lit(b))])
    one = lambda c: F.when(F.try_element_at(low, c["status"]).isNull(), F.concat(F.lit("status:"), F.coalesce(c["reason_id"], F.lit("?")))).when(~c["support_score"].between(F.element_at(low, c["status"]), F.element_at(high, c["status"])), F.concat(F.lit("bounds:"), F.coalesce(c["reason_id"], F.lit("?"))))
    return F.array_compact(F.transform(claims, one))


def faithfulness(claims: Column) -> Column:
    """Mean of support / 100; 0 without claims (a hard gate of its own)."""
    return F.when(F.size(claims) > 0, F.aggregate(claims, F.lit(0.0), lambda a, c: a + c["support_score"] / 100.0) / F.size(claims)).otherwise(0.0)


def cited_cards(rows: DataFrame, key: str, parsed: str, visible: str, clean: str, manipulated: str) -> DataFrame:
    """(key, reason, citation, card_id, role): each citation mapped to the hidden card with the shown content; card_id null if none."""
    flat = rows.select(key, visible, clean, manipulated, F.posexplode(f"{parsed}.reasons").alias("reason", "r")).select("*", F.explode("r.citations").alias("citation"))
    shown = F.try_element_at(visible, F.col("citation"))["content"]
    of = lambda arr: F.try_element_at(F.filter(arr, lambda c: c["content"] == shown), F.lit(1))["id"]
    card = F.coalesce(of(clean), of(manipulated))
    return flat.select(key, (F.col("reason") + 1).alias("reason"), "citation", card.alias("card_id"), F.when(of(clean).isNotNull(), "clean").when(of(manipulated).isNotNull(), "manipulated").alias("role"))
