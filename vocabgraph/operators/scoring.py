"""Profiles, ranks and explanations of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MAPPING, ONTOLOGICAL, kind_label
from ..sources.tables import VocabularyTables
from .edges import EdgeFilter
from .lookup import predicates
from .paths import ShortestPaths, path_nodes, shortest_paths

COUNTERS = ["invalid_concepts", "non_standard_concepts", "metadata_edges", "mapping_edges", "vocabulary_switches", "hops", "ontological_edges"]


def path_rank():
    """Struct of the counters, lower is better; of two otherwise equal paths the one with more ontological edges leads."""
    return F.struct(*COUNTERS[:-1], (-F.col("ontological_edges")).alias("minus_ontological"))


def path_profile(tables: VocabularyTables, paths: DataFrame) -> DataFrame:
    """``paths`` (pair_id, path_no, hops, steps) with COUNTERS.

    Over a path's nodes: concepts with an invalid_reason (an empty text is none), without a standard flag, and switches from the
    node before to another vocabulary (none after a null or empty one). Over its steps: ontological, mapping and all other
    edges. A path without steps has all zero.
    """
    key = ["pair_id", "path_no"]
    concept = tables.concept.select(F.col("concept_id").alias("node"), "vocabulary_id", "standard_concept", "invalid_reason", F.lit(True).alias("_known"))
    nodes = paths.select(*key, F.posexplode(path_nodes(F.col("steps"))).alias("pos", "node")).join(concept, "node", "left")
    before = F.lag("vocabulary_id").over(Window.partitionBy(*key).orderBy("pos"))
    nodes = nodes.withColumn("_switch", F.when(F.coalesce(before, F.lit("")) != "", ~before.eqNullSafe(F.col("vocabulary_id"))).otherwise(False))
    by_node = nodes.groupBy(*key).agg(
        F.sum(F.when(F.coalesce("invalid_reason", F.lit("")) != "", 1).otherwise(0)).alias("invalid_concepts"),
        F.sum(F.when(F.col("_known") & F.col("standard_concept").isNull(), 1).otherwise(0)).alias("non_standard_concepts"),
        F.sum(F.col("_switch").cast("int")).alias("vocabulary_switches"),
    )
    kinds = predicates(tables).select("predicate_id", "kind")
    steps = paths.select(*key, F.explode("steps").alias("step")).select(*key, F.col("step.predicate").alias("predicate_id")).join(kinds, "predicate_id", "left")
    by_step = steps.groupBy(*key).agg(
        F.sum(F.when(F.col("kind") == ONTOLOGICAL, 1).otherwise(0)).alias("ontological_edges"),
        F.sum(F.when(F.col("kind") == MAPPING, 1).otherwise(0)).alias("mapping_edges"),
        F.sum(F.when(F.coalesce("kind", F.lit("")).isin(ONTOLOGICAL, MAPPING), 0).otherwise(1)).alias("metadata_edges"),
    )
    out = paths.join(by_node, key, "left").join(by_step, key, "left")
    return out.select(*key, "steps", *[(F.size("steps") if c == "hops" else F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in COUNTERS])


def rank_paths(profiled: DataFrame) -> DataFrame:
    """``profiled`` plus rank_no within each pair; ties keep the order of path_no."""
    return profiled.withColumn("rank_no", F.row_number().over(Window.partitionBy("pair_id").orderBy(path_rank(), "path_no")))


def explain(tables: VocabularyTables, paths: DataFrame, expansions: DataFrame | None = None, turns: DataFrame | None = None) -> DataFrame:
    """(pair_id, path_no, step_no, subject, predicate, object, traversal_depth, kind, reason).

    ``expansions``: (pair_id, side, depth, node). traversal_depth is the depth at which the search from the source opened the step's subject,
    and so met this edge; null if only the search from the target did, or with neither ``expansions`` nor ``turns``. ``turns``: (pair_id, turn)
    says the same of shortest paths, whose first ``turn`` steps the search from the source opened.
    """
    steps = paths.select("pair_id", "path_no", F.posexplode("steps").alias("pos", "step")).select("pair_id", "path_no", (F.col("pos") + 1).alias("step_no"), "step.subject", "step.predicate", "step.object")
    if turns is not None:
        steps = steps.join(turns, "pair_id", "left").withColumn("traversal_depth", F.when(F.col("step_no") <= F.col("turn"), F.col("step_no") - 1))
    elif expansions is None:
        steps = steps.withColumn("traversal_depth", F.lit(None).cast("int"))
    else:
        seen = expansions.where("side = 'forward'").select("pair_id", F.col("node").alias("subject"), F.col("depth").alias("traversal_depth"))
        steps = steps.join(seen, ["pair_id", "subject"], "left")
    kinds = predicates(tables).select(F.col("predicate_id").alias("predicate"), "kind")
    out = steps.join(kinds, "predicate", "left")
    return out.select("pair_id", "path_no", "step_no", "subject", "predicate", "object", "traversal_depth", "kind", kind_label(F.col("kind")).alias("reason"))


def ranked_paths_with_explanations(tables: VocabularyTables, edges: DataFrame, pairs: DataFrame, *, rule: EdgeFilter | None = None, max_depth: int = 6, max_paths: int = 20) -> tuple[DataFrame, DataFrame, ShortestPaths]:
    """(ranked paths, explanations, search): find, then rank, then explain. Pairs without a path give no rows."""
    found = shortest_paths(edges, pairs, rule=rule, max_depth=max_depth, max_paths=max_paths)
    ranked = rank_paths(path_profile(tables, found.paths))
    return ranked, explain(tables, ranked, found.expansions), found
