"""Traversal of the lineage graph: nodes (id, label, labels, name, ...) and edges (src, dst, rel, ...).

Reachability is a loop of frontier joins. Each step shuffles on the frontier's ids only, drops what has been
visited by an anti-join, and is written out, so plans stay flat and a lost executor repeats one step.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import discard, written


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(at, to, rel): edges as steps. direction: out, in, or both."""
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "rel")
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), "rel")
    return {"out": out, "in": back}.get(direction) if direction != "both" else out.unionByName(back)


def _levels(max_depth: int | None):
    return count(1) if max_depth is None else range(1, max_depth + 1)


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """(at, to) written once: every level reads it, and none computes the edges' ids again."""
    return written(directed(edges, direction).select("at", "to"), "steps")


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = 6, direction: str = "out", rels: list[str] | None = None, include_seeds: bool = False) -> DataFrame:
    """(id, depth): every node within max_depth steps (None: any number) of a seed (column id), at its least depth."""
    if rels is not None:
        edges = edges.filter(F.col("rel").isin(rels))
    steps = _steps(edges, direction)
    visited = written(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "reach")
    frontier = visited
    for depth in _levels(max_depth):
        found = frontier.select(F.col("id").alias("at")).join(steps, "at").select(F.col("to").alias("id")).distinct()
        found = found.join(visited.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth))
        frontier = written(found, "reach")
        if not frontier.limit(1).count():
            break
        visited = visited.unionByName(frontier)
    discard(steps)
    return visited if include_seeds else visited.filter("depth > 0")


def reach_from_each(edges: DataFrame, seeds: DataFrame, max_depth: int | None = 6, direction: str = "out") -> DataFrame:
    """(root, id, depth): reach() for many seeds at once, kept apart."""
    steps = _steps(edges, direction)
    visited = written(seeds.select(F.col("id").alias("root"), "id").distinct().withColumn("depth", F.lit(0)), "reach")
    frontier = visited
    for depth in _levels(max_depth):
        found = frontier.select("root", F.col("id").alias("at")).join(steps, "at").select("root", F.col("to").alias("id")).distinct()
        found = found.join(visited.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = written(found, "reach")
        if not frontier.limit(1).count():
            break
        visited = visited.unionByName(frontier)
    discard(steps)
    return visited


def trails(edges: DataFrame, seeds: DataFrame, max_depth: int = 6, direction: str = "out", limit: int | None = 500) -> DataFrame:
    """(start, depth, node, path array<string>): paths that use no edge twice, shortest first, then by path.

    The order makes the limit deterministic. As shorter paths come first, no path is made beyond the length at which
    the limit is reached: paths grow with the degree to the power of the length. reach() has no such growth.
    With a limit of None, every path, in no order.
    """
    keyed = edges.select(F.concat_ws("|", "src", "rel", "dst").alias("eid"), "src", "dst")
    out = keyed.select(F.col("src").alias("node"), F.col("dst").alias("next"), "eid")
    back = keyed.select(F.col("dst").alias("node"), F.col("src").alias("next"), "eid")
    steps = written({"out": out, "in": back, "both": out.unionByName(back)}[direction], "steps")
    paths = seeds.select(F.col("id").alias("start"), F.lit(0).alias("depth"), F.col("id").alias("node"), F.array("id").alias("path"), F.array().cast("array<string>").alias("used"))
    every, found = None, 0
    for _ in range(max_depth):
        paths = paths.join(steps, "node").filter(~F.array_contains("used", F.col("eid")))
        paths = written(paths.select("start", (F.col("depth") + 1).alias("depth"), F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), F.concat("used", F.array("eid")).alias("used")), "trails")
        every = paths if every is None else every.unionByName(paths)
        n = paths.count()
        found += n
        if not n or (limit is not None and found >= limit):
            break
    discard(steps)
    if limit is None:
        return every.select("start", "depth", "node", "path")
    return every.orderBy("depth", F.concat_ws(">", "path")).limit(limit).select("start", "depth", "node", "path")


def on_cycles(edges: DataFrame, max_depth: int) -> DataFrame:
    """(id): nodes that reach themselves within max_depth steps: first trimmed to those with both ends open."""
    live = edges.select("src", "dst").distinct()
    for _ in range(max_depth):
        kept = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = written(kept.join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "cycle")
        if kept.count() == live.count():
            break
        live = kept
    roots = live.select(F.col("src").alias("id")).distinct()
    found = reach_from_each(live.withColumn("rel", F.lit("")), roots, max_depth)
    # The seed itself is at depth 0; it is on a cycle if one of what it reaches has an edge back.
    back = found.join(live.select(F.col("src").alias("id"), F.col("dst").alias("root")), ["id", "root"], "left_semi")
    return back.select(F.col("root").alias("id")).distinct()


def flow_edges(edges: DataFrame, flows: dict[str, int]) -> DataFrame:
    """Edges turned into the direction of data: flow -1 of a relation swaps its ends, 0 leaves it out."""
    flow = F.coalesce(F.create_map(*[F.lit(x) for kv in flows.items() for x in kv])[F.col("rel")], F.lit(1)) if flows else F.lit(1)
    turned = edges.withColumn("__flow", flow).filter("__flow <> 0")
    src, dst = F.col("src"), F.col("dst")
    turn = F.col("__flow") < 0
    return turned.withColumns({"src": F.when(turn, dst).otherwise(src), "dst": F.when(turn, src).otherwise(dst)}).drop("__flow")


def anchors(edges: DataFrame, nodes: DataFrame, named: Column) -> DataFrame:
    """(id, fan_out, is_root, is_anchor): anchors are named nodes, roots and forks of two consumers or more."""
    fan = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    fed = edges.select(F.col("dst").alias("id")).distinct().withColumn("fed", F.lit(True))
    rows = nodes.join(fan, "id", "left").join(fed, "id", "left")
    rows = rows.select("id", F.coalesce("fan_out", F.lit(0)).alias("fan_out"), F.col("fed").isNull().alias("is_root"), named.alias("named"))
    return rows.withColumn("is_anchor", F.col("named") | F.col("is_root") | (F.col("fan_out") >= 2)).drop("named")


def combined(edges: DataFrame, seeds: DataFrame, max_depth: int = 6) -> DataFrame:
    """(id, depth): union of what lies up and down of any seed, at the least depth."""
    up, down = reach(edges, seeds, max_depth, "in", include_seeds=True), reach(edges, seeds, max_depth, "out")
    return up.unionByName(down).groupBy("id").agg(F.min("depth").alias("depth"))
