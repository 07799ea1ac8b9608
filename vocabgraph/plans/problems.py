"""The registered queries of the general data problems: orphans (p2), hierarchies (p5), heavy keys (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forest import all_descendants, closure_findings, hierarchy
from ..operators.orphans import Reference, orphan_references, orphan_report
from ..operators.skew import eager_join_aggregate, heavy_join_keys, key_profile

HEAVY_SHARE = 0.02


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _read(spark, sf_dir, "concept_relationship").where("invalid_reason IS NULL")
    synonyms = _read(spark, sf_dir, "concept_synonym")
    references = [Reference(links, "concept_relationship", "concept_id_1"), Reference(links, "concept_relationship", "concept_id_2"), Reference(synonyms, "concept_synonym", "concept_id")]
    return orphan_references(references, _read(spark, sf_dir, "concept"), "concept_id").withColumnRenamed("key", "concept_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("origin_table", "ref_field", "concept_id", "load_month", "reason")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


def upward_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent) of the valid 'Is a' and 'Subsumes' rows with both ends in concept."""
    rows = _read(spark, sf_dir, "concept_relationship").where("invalid_reason IS NULL AND relationship_id IN ('Is a', 'Subsumes')")
    up = F.col("relationship_id") == "Is a"
    links = rows.select(F.when(up, F.col("concept_id_1")).otherwise(F.col("concept_id_2")).alias("child"), F.when(up, F.col("concept_id_2")).otherwise(F.col("concept_id_1")).alias("parent")).distinct()
    ids = _read(spark, sf_dir, "concept").select("concept_id").distinct()
    return links.join(ids.withColumnRenamed("concept_id", "child"), "child", "left_semi").join(ids.withColumnRenamed("concept_id", "parent"), "parent", "left_semi").select("child", "parent")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = _read(spark, sf_dir, "concept_ancestor").select(F.col("ancestor_concept_id").alias("ancestor"), F.col("descendant_concept_id").alias("descendant"), F.col("min_levels_of_separation").alias("distance"))
    nodes = _read(spark, sf_dir, "concept").select(F.col("concept_id").alias("node"))
    return closure_findings(upward_links(spark, sf_dir), stated, nodes).select(F.col("node").alias("concept_id"), "finding")


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy(upward_links(spark, sf_dir))
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), "/")
    return tree.select(F.col("node").alias("concept_id"), F.col("depth").cast("long").alias("depth"), F.col("root").alias("root_id"), path.alias("path"), "n_descendants", "on_cycle")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every concept below each concept, with the smallest number of links."""
    return all_descendants(upward_links(spark, sf_dir)).select(F.col("node").alias("concept_id"), F.col("descendant").alias("descendant_id"), F.col("distance").cast("long").alias("distance"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavy keys of both tables, from the joined states of their join on the concept."""
    return _heavy(spark, sf_dir).select("origin_table", "concept_id")


def p6_heavy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heavy keys with their rows and the pairs that they would join to."""
    return _heavy(spark, sf_dir).select("origin_table", "concept_id", "n_rows", "n_pairs")


def _heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = heavy_join_keys(_read(spark, sf_dir, "concept_relationship"), _read(spark, sf_dir, "concept_ancestor"), "concept_id_1", "ancestor_concept_id", HEAVY_SHARE)
    return found.select(F.when(F.col("side") == "left", "concept_relationship").otherwise("concept_ancestor").alias("origin_table"), F.col("key").alias("concept_id"), "n_rows", "n_pairs")


def p6_key_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, partners and relationship kinds of every concept_id_1."""
    return key_profile(_read(spark, sf_dir, "concept_relationship"), "concept_id_1", {"n_partners": "concept_id_2", "n_kinds": "relationship_id"})


def p6_join_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per relationship kind: rows and summed levels of concept_relationship joined to concept_ancestor on the ancestor."""
    return eager_join_aggregate(
        _read(spark, sf_dir, "concept_relationship"), _read(spark, sf_dir, "concept_ancestor"), "concept_id_1", "ancestor_concept_id", "relationship_id", {"sum_levels": F.col("min_levels_of_separation").cast("long")}
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p5_found, p5_hierarchy, p5_descendants, p6_found, p6_heavy_pairs, p6_key_profile, p6_join_rollup)}

_ORPHANS = """
WITH state AS (
  SELECT concept_id, min(loaded_at) AS first_at, arg_max(coalesce(invalid_reason = 'D', false), loaded_at) AS deleted FROM concept GROUP BY concept_id),
refs AS (
  SELECT 'concept_relationship' AS origin_table, 'concept_id_1' AS ref_field, concept_id_1 AS concept_id, loaded_at FROM concept_relationship WHERE invalid_reason IS NULL
  UNION ALL SELECT 'concept_relationship', 'concept_id_2', concept_id_2, loaded_at FROM concept_relationship WHERE invalid_reason IS NULL
  UNION ALL SELECT 'concept_synonym', 'concept_id', concept_id, loaded_at FROM concept_synonym),
cases AS (
  SELECT DISTINCT r.origin_table, r.ref_field, r.concept_id, strftime(r.loaded_at, '%Y-%m') AS load_month,
    CASE WHEN s.concept_id IS NULL THEN 'missing' WHEN s.deleted THEN 'deleted' WHEN s.first_at > r.loaded_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN state s ON s.concept_id = r.concept_id WHERE r.concept_id IS NOT NULL)
"""

_LINKS = """
links AS (
  SELECT DISTINCT child, parent FROM (
    SELECT concept_id_1 AS child, concept_id_2 AS parent FROM concept_relationship WHERE relationship_id = 'Is a' AND invalid_reason IS NULL
    UNION ALL SELECT concept_id_2, concept_id_1 FROM concept_relationship WHERE relationship_id = 'Subsumes' AND invalid_reason IS NULL)
  WHERE child IN (SELECT concept_id FROM concept) AND parent IN (SELECT concept_id FROM concept))
"""

#: recursion with UNION ends because distances are bounded; shortest ways have fewer links than there are concepts in a chain
_REACH = f"""
WITH RECURSIVE {_LINKS},
walk(node, top, n) AS (
  SELECT child, parent, 1 FROM links
  UNION SELECT w.node, l.parent, w.n + 1 FROM walk w JOIN links l ON l.child = w.top WHERE w.n < 60),
reach AS (SELECT node, top, min(n) AS n FROM walk GROUP BY node, top)
"""

ORACLE = {
    "p2_found": _ORPHANS + "SELECT * FROM cases WHERE reason IS NOT NULL",
    "p2_report": _ORPHANS
    + """SELECT origin_table, ref_field, load_month, reason, count(*) AS n_keys,
      round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY origin_table, ref_field, load_month), 6) AS share
    FROM cases WHERE reason IS NOT NULL GROUP BY origin_table, ref_field, load_month, reason""",
    "p5_found": _REACH
    + """, real AS (SELECT node, top, n FROM reach WHERE node <> top),
    said AS (SELECT DISTINCT descendant_concept_id AS node, ancestor_concept_id AS top, min_levels_of_separation AS n FROM concept_ancestor WHERE ancestor_concept_id <> descendant_concept_id),
    differ AS (SELECT node FROM (SELECT * FROM real EXCEPT SELECT * FROM said) UNION SELECT node FROM (SELECT * FROM said EXCEPT SELECT * FROM real))
    SELECT node AS concept_id, 'cycle' AS finding FROM reach WHERE node = top
    UNION SELECT node, 'level' FROM differ WHERE node IN (SELECT concept_id FROM concept)""",
    "p5_hierarchy": _REACH
    + """, proper AS (SELECT * FROM links WHERE child <> parent),
    nodes AS (SELECT child AS node FROM links UNION SELECT parent FROM links),
    cyclic AS (SELECT node FROM reach WHERE node = top),
    tops AS (SELECT node FROM nodes WHERE node NOT IN (SELECT child FROM proper) AND node NOT IN (SELECT node FROM cyclic)),
    down(node, depth) AS (SELECT node, 0 FROM tops UNION SELECT p.child, d.depth + 1 FROM down d JOIN proper p ON p.parent = d.node WHERE d.depth < 60),
    placed AS (SELECT node, min(depth) AS depth FROM down GROUP BY node),
    chosen AS (SELECT child, parent FROM (SELECT p.child, p.parent, row_number() OVER (PARTITION BY p.child ORDER BY d.depth, p.parent) AS rn FROM proper p JOIN placed d ON d.node = p.parent) WHERE rn = 1),
    paths(node, root, path) AS (SELECT node, node, CAST(node AS VARCHAR) FROM tops UNION ALL SELECT c.child, p.root, concat(p.path, '/', c.child) FROM paths p JOIN chosen c ON c.parent = p.node),
    below AS (SELECT top AS node, count(*) AS n FROM reach WHERE node <> top GROUP BY top)
    SELECT n.node AS concept_id, CASE WHEN c.node IS NULL THEN CAST(d.depth AS BIGINT) END AS depth, CASE WHEN c.node IS NULL THEN p.root END AS root_id, CASE WHEN c.node IS NULL THEN p.path END AS path,
      coalesce(b.n, 0) AS n_descendants, c.node IS NOT NULL AS on_cycle
    FROM nodes n LEFT JOIN placed d ON d.node = n.node LEFT JOIN paths p ON p.node = n.node LEFT JOIN below b ON b.node = n.node LEFT JOIN cyclic c ON c.node = n.node""",
    "p5_descendants": _REACH + " SELECT top AS concept_id, node AS descendant_id, CAST(n AS BIGINT) AS distance FROM reach",
    "p6_found": f"""
    SELECT 'concept_relationship' AS origin_table, concept_id_1 AS concept_id FROM concept_relationship WHERE concept_id_1 IS NOT NULL
      GROUP BY concept_id_1 HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM concept_relationship)
    UNION ALL SELECT 'concept_ancestor', ancestor_concept_id FROM concept_ancestor WHERE ancestor_concept_id IS NOT NULL
      GROUP BY ancestor_concept_id HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM concept_ancestor)""",
    "p6_heavy_pairs": f"""
    WITH l AS (SELECT concept_id_1 AS k, count(*) AS n FROM concept_relationship GROUP BY 1), r AS (SELECT ancestor_concept_id AS k, count(*) AS n FROM concept_ancestor GROUP BY 1)
    SELECT 'concept_relationship' AS origin_table, l.k AS concept_id, l.n AS n_rows, l.n * coalesce(r.n, 0) AS n_pairs FROM l LEFT JOIN r ON r.k = l.k WHERE l.k IS NOT NULL AND l.n >= {HEAVY_SHARE} * (SELECT count(*) FROM concept_relationship)
    UNION ALL SELECT 'concept_ancestor', r.k, r.n, r.n * coalesce(l.n, 0) FROM r LEFT JOIN l ON l.k = r.k WHERE r.k IS NOT NULL AND r.n >= {HEAVY_SHARE} * (SELECT count(*) FROM concept_ancestor)""",
    "p6_key_profile": "SELECT concept_id_1, count(*) AS n_rows, count(DISTINCT concept_id_2) AS n_partners, count(DISTINCT relationship_id) AS n_kinds FROM concept_relationship WHERE concept_id_1 IS NOT NULL GROUP BY concept_id_1",
    "p6_join_rollup": "SELECT r.relationship_id, count(*) AS n_pairs, CAST(sum(a.min_levels_of_separation) AS BIGINT) AS sum_levels FROM concept_relationship r JOIN concept_ancestor a ON a.ancestor_concept_id = r.concept_id_1 GROUP BY r.relationship_id",
}
