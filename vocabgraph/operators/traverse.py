"""Bounded breadth-first traversal of many seed sets at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .edges import EDGE_COLUMNS, EdgeFilter


@dataclass(frozen=True)
class Traversal:
    """nodes: (query_id, node, depth, expanded); edges: (query_id, EDGE_COLUMNS), one per subject, predicate and object; trace: (query_id,
    step_no, depth, node, EDGE_COLUMNS), a row with null edge columns for an expansion without edges; summary: (query_id,
    terminated_reason)."""

    nodes: DataFrame
    edges: DataFrame
    trace: DataFrame
    summary: DataFrame


def reach_levels(links: DataFrame, seeds: DataFrame, max_depth: int, scratch: Scratch) -> list[DataFrame]:
    """(query_id, node, depth) of what is first met at each depth up to ``max_depth`` along ``links`` (subject_id, object_id), each level written.

    ``links`` is read once per level and should be a written table.
    """
    pairs = links.select("subject_id", "object_id")
    every = seeds.select("query_id", "node").dropna().distinct().withColumn("depth", F.lit(0))
    levels = [scratch.cut(every, "level-0")]
    every = levels[0]
    for depth in range(1, max_depth + 1):
        step = levels[-1].join(pairs, F.col("node") == F.col("subject_id")).select("query_id", F.col("object_id").alias("node")).distinct()
        met, n = scratch.counted(step.join(every.select("query_id", "node"), ["query_id", "node"], "left_anti").withColumn("depth", F.lit(depth)), f"level-{depth}")
        if not n:
            break
        levels.append(met)
        every = every.unionByName(met)
    return levels


def traverse(edges: DataFrame, seeds: DataFrame, *, rule: EdgeFilter | None = None, max_depth: int, max_nodes: int | None = None) -> Traversal:
    """Traverse from ``seeds`` (query_id, node) along outgoing edges that pass ``rule``.

    Nodes at ``max_depth`` are visited but not expanded. With ``max_nodes`` N the first N nodes by (depth, id) are kept and the
    first N - 1 expanded, and the reason is 'max_nodes' if there were at least N; 0 or None means no bound. Seeds count
    once; unknown seeds are visited without edges. Edges to nodes seen before, or cut off by N, are kept. The edges that
    pass are written once, so the vocabulary tables are read once however many levels there are.
    """
    rule = rule or EdgeFilter()
    scratch = Scratch(edges.sparkSession, "traverse")
    passing = scratch.cut(edges.where(rule.condition()).select(*EDGE_COLUMNS).dropDuplicates(["subject_id", "predicate_id", "object_id"]), "passing")
    found = reduce(DataFrame.unionByName, reach_levels(passing, seeds, max_depth, scratch))
    asked = seeds.select("query_id").dropna().distinct()
    if max_nodes:
        order = Window.partitionBy("query_id").orderBy("depth", "node")
        # the filter on row_number lets Spark keep only N rows per query before the shuffle
        found = found.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= max_nodes)
        nodes = found.select("query_id", "node", "depth", ((F.col("depth") < max_depth) & (F.col("_no") < max_nodes)).alias("expanded"))
        full = found.where(F.col("_no") == max_nodes).select("query_id", F.lit("max_nodes").alias("terminated_reason"))
        summary = asked.join(full, "query_id", "left")
    else:
        nodes = found.select("query_id", "node", "depth", (F.col("depth") < max_depth).alias("expanded"))
        summary = asked.withColumn("terminated_reason", F.lit(None).cast("string"))
    nodes = scratch.cut(nodes, "nodes")
    opened = nodes.where("expanded").select("query_id", "node", "depth")
    steps = opened.withColumn("step_no", F.row_number().over(Window.partitionBy("query_id").orderBy("depth", "node")))
    trace = steps.join(passing, F.col("node") == F.col("subject_id"), "left").select("query_id", "step_no", "depth", "node", *EDGE_COLUMNS)
    kept = opened.select("query_id", F.col("node").alias("subject_id")).join(passing, "subject_id").select("query_id", *EDGE_COLUMNS)
    return Traversal(nodes, kept, trace, summary)
