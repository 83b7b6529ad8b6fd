"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.operators.selection import with_position
from rillstone.session import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionAll(moved).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each node of an edge with the smallest node of its component: (node, component).

    Every step sends a node's edges to its least neighbour, by a pre-aggregated minimum
    joined back on the node, so that a hub is split like any skewed join and no
    neighbour list is ever gathered. Each round is written to the shared folder, and rounds go on
    until one changes nothing. String nodes are numbered in their order first, so that the rounds
    shuffle and hash whole numbers. Edges with a null end and self-loops give no link; a node
    known only from a self-loop is its own component. No edges give an empty table. Other columns
    are ignored.
    """
    named = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    if dict(named.dtypes)["u"] != "string":
        return _settled(named)
    named = materialize(named.distinct(), "named-edges")
    nodes = with_position(named.select(F.col("u").alias("name")).unionAll(named.select("v")).distinct(), ["name"], "n")
    end = lambda c: nodes.select(F.col("name").alias(c), F.col("n").alias(f"{c}n"))
    found = _settled(named.join(end("u"), "u").join(end("v"), "v").select(F.col("un").alias("u"), F.col("vn").alias("v")))
    node, root = (nodes.select(F.col("n").alias(c), F.col("name").alias(f"{c}_name")) for c in ("node", "component"))
    return found.join(node, "node").join(root, "component").select(F.col("node_name").alias("node"), F.col("component_name").alias("component"))


def _settled(named: DataFrame) -> DataFrame:
    now = materialize(named.where("u != v").distinct(), "edges")
    loops = named.where("u = v").select("u").distinct()
    mark = None
    while True:
        before, now = now, materialize(_small_star(_large_star(now)), "edges")
        discard(before)
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**40)))).first())
        if seen == mark:
            break
        mark = seen
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    known = nodes.unionAll(roots)
    alone = loops.join(known, loops.u == known.node, "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component"))
    return known.unionAll(alone)
