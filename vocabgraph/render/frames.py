"""Renderings as DataFrames: one text per query or path, built in the cluster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import VocabularyTables


def _named_steps(tables: VocabularyTables, paths: DataFrame) -> DataFrame:
    names = tables.concept.select("concept_id", F.coalesce("concept_name", F.lit("")).alias("name"))
    steps = paths.select("pair_id", "path_no", F.posexplode("steps").alias("pos", "step")).select("pair_id", "path_no", "pos", "step.subject", "step.predicate", "step.object")
    known = steps.join(names.toDF("subject", "subject_name"), "subject", "left").join(names.toDF("object", "object_name"), "object", "left")
    return known.fillna("", ["subject_name", "object_name"])


def _joined(lines: DataFrame, keys: list[str], order: list[str], head: str = "", glue: str = "\n") -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), glue)
    return lines.groupBy(*keys).agg((F.concat(F.lit(head), body) if head else body).alias("rendered"))


def path_text(tables: VocabularyTables, paths: DataFrame) -> DataFrame:
    """(pair_id, path_no, rendered): 'A --[p]--> B', one line per step. Paths without steps give no row."""
    line = F.concat("subject_name", F.lit(" --["), "predicate", F.lit("]--> "), "object_name")
    return _joined(_named_steps(tables, paths).withColumn("line", line), ["pair_id", "path_no"], ["pos"])


def path_mermaid(tables: VocabularyTables, paths: DataFrame) -> DataFrame:
    """(pair_id, path_no, rendered): a 'graph LR' with one line per step; quotes in names are escaped."""
    safe = lambda c: F.replace(F.col(c), F.lit('"'), F.lit("#quot;"))
    line = F.concat(F.col("subject").cast("string"), F.lit('["'), safe("subject_name"), F.lit('"] -->|'), "predicate", F.lit("| "), F.col("object").cast("string"), F.lit('["'), safe("object_name"), F.lit('"]'))
    return _joined(_named_steps(tables, paths).withColumn("line", line), ["pair_id", "path_no"], ["pos"], "graph LR\n")


def subgraph_text(tables: VocabularyTables, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, rendered): counts, then the nodes by id with their vocabulary and code."""
    known = nodes.join(tables.concept.select(F.col("concept_id").alias("node"), "concept_name", "vocabulary_id", "concept_code"), "node", "left")
    line = F.concat(F.lit("- "), F.coalesce("concept_name", F.lit("")), F.lit(" ("), F.coalesce("vocabulary_id", F.lit("")), F.lit(":"), F.coalesce("concept_code", F.lit("")), F.lit(")"))
    listed = _joined(known.withColumn("line", line), ["query_id"], ["node"])
    counts = nodes.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_nodes")).join(edges.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_edges")), "query_id", "left")
    head = F.concat(F.lit("Subgraph:\n  Nodes: "), F.col("n_nodes").cast("string"), F.lit("\n  Edges: "), F.coalesce("n_edges", F.lit(0)).cast("string"), F.lit("\n\n"))
    return counts.join(listed, "query_id").select("query_id", F.concat(head, "rendered").alias("rendered"))


def subgraph_mermaid(tables: VocabularyTables, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, rendered): a 'graph TD' with the nodes by id and the edges, named by their predicates; quotes in names are escaped."""
    text = lambda c: F.coalesce(c, F.lit(""))
    known = nodes.select("query_id", "node").join(tables.concept.select(F.col("concept_id").alias("node"), "concept_name", "vocabulary_id", "concept_code"), "node", "left")
    label = F.concat(F.lit("  "), F.col("node").cast("string"), F.lit('["'), F.replace(text("concept_name"), F.lit('"'), F.lit("#quot;")), F.lit("\\n"), text("vocabulary_id"), F.lit(":"), text("concept_code"), F.lit('"]'))
    names = tables.relationship.select(F.col("relationship_id").alias("predicate_id"), "relationship_name")
    arrow = F.concat(F.lit("  "), F.col("subject_id").cast("string"), F.lit(" -->|"), text("relationship_name"), F.lit("| "), F.col("object_id").cast("string"))
    none = F.lit(0).cast("long")
    lines = known.select("query_id", F.lit(0).alias("part"), F.col("node").alias("a"), F.lit("").alias("p"), none.alias("b"), label.alias("line"))
    lines = lines.unionByName(edges.join(names, "predicate_id", "left").select("query_id", F.lit(1).alias("part"), F.col("subject_id").alias("a"), F.col("predicate_id").alias("p"), F.col("object_id").alias("b"), arrow.alias("line")))
    return _joined(lines, ["query_id"], ["part", "a", "p", "b"], "graph TD\n")


def trace_text(tables: VocabularyTables, trace: DataFrame, summary: DataFrame, targets: int = 6) -> DataFrame:
    """(query_id, rendered): per expansion its depth and node, below it each predicate with its first ``targets`` targets by id and how many more."""
    names = tables.concept.select("concept_id", F.coalesce("concept_name", F.lit("")).alias("name"))
    predicates = tables.relationship.select(F.col("relationship_id").alias("predicate_id"), F.coalesce("relationship_name", F.lit("")).alias("predicate"))
    key = ["query_id", "step_no", "predicate_id"]
    heads = trace.select("query_id", "step_no", "depth", F.col("node").alias("concept_id")).distinct().join(names, "concept_id", "left")
    heads = heads.select("query_id", "step_no", F.lit("").alias("predicate_id"), F.lit(0).alias("no"), F.concat(F.lit("[depth "), F.col("depth").cast("string"), F.lit("] "), F.coalesce("name", F.lit(""))).alias("line"))
    met = trace.where("predicate_id IS NOT NULL").select(*key, F.col("object_id").alias("concept_id"))
    met = met.withColumn("no", F.row_number().over(Window.partitionBy(*key).orderBy("concept_id")))
    groups = met.groupBy(*key).agg(F.max("no").alias("n")).join(predicates, "predicate_id", "left")
    parts = [
        heads,
        groups.select(*key, F.lit(0).alias("no"), F.concat(F.lit("    └─ "), F.coalesce("predicate", F.lit(""))).alias("line")),
        met.where(F.col("no") <= targets).join(names, "concept_id", "left").select(*key, "no", F.concat(F.lit("        → "), F.coalesce("name", F.lit(""))).alias("line")),
        groups.where(F.col("n") > targets).select(*key, F.lit(targets + 1).alias("no"), F.concat(F.lit("        … "), (F.col("n") - targets).cast("string"), F.lit(" more")).alias("line")),
        summary.where("terminated_reason IS NOT NULL").select("query_id", F.lit(2**31 - 1).alias("step_no"), F.lit("").alias("predicate_id"), F.lit(0).alias("no"), F.concat(F.lit("[terminated: "), "terminated_reason", F.lit("]")).alias("line")),
    ]
    return _joined(reduce(DataFrame.unionByName, parts), ["query_id"], ["step_no", "predicate_id", "no"])
