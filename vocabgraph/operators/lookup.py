"""Batch lookups of concepts, predicates and synonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import kind_label, predicate_kind
from ..sources.tables import CONCEPT, VocabularyTables


class NotExactlyOne(LookupError):
    """A strict lookup met a key with no row, or with more than one."""


def concept_view(tables: VocabularyTables, ids: DataFrame, *, strict: bool = False) -> DataFrame:
    """The ten concept columns of the distinct ``ids`` (concept_id). Unknown ids give no row, or NotExactlyOne if ``strict``."""
    own = ids.select("concept_id").dropna().distinct()
    if strict:
        gone = own.join(tables.concept.select("concept_id"), "concept_id", "left_anti").limit(5).collect()
        if gone:
            raise NotExactlyOne(f"no concept with id {[r[0] for r in gone]}")
    return tables.concept.join(own, "concept_id", "left_semi").select(*CONCEPT)


def concept_id_by_code(tables: VocabularyTables, codes: DataFrame, *, strict: bool = False) -> DataFrame:
    """(vocabulary_id, concept_code, concept_id) for ``codes`` (vocabulary_id, concept_code), letter case exact.

    A code may have several concepts, or none; with ``strict`` either raises NotExactlyOne.
    """
    own = codes.select("vocabulary_id", "concept_code").dropna().distinct()
    out = own.join(tables.concept.select("vocabulary_id", "concept_code", "concept_id"), ["vocabulary_id", "concept_code"], "left" if strict else "inner")
    if strict:
        bad = out.groupBy("vocabulary_id", "concept_code").agg(F.count("concept_id").alias("n")).where("n <> 1").limit(5).collect()
        if bad:
            raise NotExactlyOne(f"codes without exactly one concept: {[tuple(r) for r in bad]}")
    return out.select("vocabulary_id", "concept_code", "concept_id")


def predicates(tables: VocabularyTables) -> DataFrame:
    """(predicate_id, name, reverse_id, is_hierarchical, defines_ancestry, kind, reason), one row per predicate."""
    kind = predicate_kind(F.col("relationship_name"), F.col("is_hierarchical"), F.col("defines_ancestry"))
    return tables.relationship.select(
        F.col("relationship_id").alias("predicate_id"), F.col("relationship_name").alias("name"), F.col("reverse_relationship_id").alias("reverse_id"), F.coalesce("is_hierarchical", F.lit(False)).alias("is_hierarchical"), F.coalesce("defines_ancestry", F.lit(False)).alias("defines_ancestry"), kind.alias("kind")
    ).withColumn("reason", kind_label(F.col("kind")))


def synonyms_of(tables: VocabularyTables, ids: DataFrame) -> DataFrame:
    """(concept_id, concept_synonym_name) of the ``ids`` that are concepts; synonyms of unknown concepts vanish."""
    own = ids.select("concept_id").dropna().distinct()
    return tables.concept_synonym.join(own, "concept_id", "left_semi").join(tables.concept.select("concept_id"), "concept_id", "left_semi").select("concept_id", "concept_synonym_name")
