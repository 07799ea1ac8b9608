"""Parents, children, ancestors, and concepts without them, from the ancestor table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import VocabularyTables


def _relatives(tables: VocabularyTables, ids: DataFrame, own: str, other: str, one_level: bool) -> DataFrame:
    rows = tables.concept_ancestor.where("min_levels_of_separation = 1") if one_level else tables.concept_ancestor
    asked = ids.select(F.col("concept_id").alias(own)).dropna().distinct()
    return rows.join(asked, own, "left_semi").select(F.col(own).alias("concept_id"), F.col(other).alias("relative_id"))


def parents(tables: VocabularyTables, ids: DataFrame) -> DataFrame:
    """(concept_id, relative_id): ancestors one level up."""
    return _relatives(tables, ids, "descendant_concept_id", "ancestor_concept_id", True)


def children(tables: VocabularyTables, ids: DataFrame) -> DataFrame:
    """(concept_id, relative_id): descendants one level down."""
    return _relatives(tables, ids, "ancestor_concept_id", "descendant_concept_id", True)


def ancestors(tables: VocabularyTables, ids: DataFrame) -> DataFrame:
    """(concept_id, relative_id): ancestors at any level, the concept itself if the table has its self row."""
    return _relatives(tables, ids, "descendant_concept_id", "ancestor_concept_id", False)


def standard_concepts(tables: VocabularyTables, *, domain_id: str | None = None, vocabulary_id: str | None = None) -> DataFrame:
    """(concept_id) of concepts with a standard flag, optionally of one domain or vocabulary; an empty text filters nothing."""
    rows = tables.concept.where("standard_concept IS NOT NULL")
    if domain_id:
        rows = rows.where(F.col("domain_id") == domain_id)
    if vocabulary_id:
        rows = rows.where(F.col("vocabulary_id") == vocabulary_id)
    return rows.select("concept_id")


def _without(tables: VocabularyTables, universe: DataFrame, column: str) -> DataFrame:
    linked = tables.concept_ancestor.where("min_levels_of_separation = 1").select(F.col(column).alias("concept_id"))
    return universe.join(linked, "concept_id", "left_anti")


def roots(tables: VocabularyTables, **only) -> DataFrame:
    """Standard concepts without a parent; the parent may be of any domain."""
    return _without(tables, standard_concepts(tables, **only), "descendant_concept_id")


def leaves(tables: VocabularyTables, **only) -> DataFrame:
    """Standard concepts without a child."""
    return _without(tables, standard_concepts(tables, **only), "ancestor_concept_id")


def singletons(tables: VocabularyTables, **only) -> DataFrame:
    """Standard concepts with neither."""
    return _without(tables, roots(tables, **only), "ancestor_concept_id")
