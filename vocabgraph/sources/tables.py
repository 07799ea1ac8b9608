"""The five vocabulary tables, from Parquet, JDBC or frames, brought to one row per key."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch

CONCEPT = ["concept_id", "concept_name", "concept_code", "vocabulary_id", "domain_id", "concept_class_id", "standard_concept", "valid_start_date", "valid_end_date", "invalid_reason"]
EDGE = ["concept_id_1", "relationship_id", "concept_id_2", "valid_start_date", "valid_end_date", "invalid_reason"]
PREDICATE = ["relationship_id", "relationship_name", "reverse_relationship_id", "is_hierarchical", "defines_ancestry"]
ANCESTOR = ["ancestor_concept_id", "descendant_concept_id", "min_levels_of_separation"]
SYNONYM = ["concept_id", "concept_synonym_name"]
NAMES = ["concept", "concept_relationship", "relationship", "concept_ancestor", "concept_synonym"]


def latest(rows: DataFrame, keys: list[str], columns: list[str], loaded_at: str = "loaded_at") -> DataFrame:
    """One row per key: the one delivered last, ties settled by the greatest remaining values, column by column.

    Aggregated map-side, so a hot key costs no more than any other. Rows with a null key are dropped; without a delivery
    time the greatest values hold. Columns: ``columns``.
    """
    rest = [c for c in columns if c not in keys]
    order = ([loaded_at] if loaded_at in rows.columns else []) + rest
    best = rows.dropna(subset=keys).groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last"))
    return best.select(*[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in columns])


@dataclass(frozen=True)
class VocabularyTables:
    concept: DataFrame
    concept_relationship: DataFrame
    relationship: DataFrame
    concept_ancestor: DataFrame
    concept_synonym: DataFrame

    @classmethod
    def from_frames(cls, concept: DataFrame, concept_relationship: DataFrame, relationship: DataFrame, concept_ancestor: DataFrame, concept_synonym: DataFrame) -> VocabularyTables:
        """Any frames with at least the columns of the data model; other columns are left out.

        concept and concept_relationship keep the row delivered last per key, repeated ancestor rows their least level;
        synonyms are distinct, null ids and names left out; flags given as text are cast to boolean.
        """
        flags = [F.col(c).cast("boolean").alias(c) if c in ("is_hierarchical", "defines_ancestry") else F.col(c) for c in PREDICATE]
        ancestors = concept_ancestor.select(*ANCESTOR).dropna(subset=ANCESTOR[:2]).groupBy(*ANCESTOR[:2]).agg(F.min(ANCESTOR[2]).alias(ANCESTOR[2]))
        return cls(
            latest(concept, ["concept_id"], CONCEPT),
            latest(concept_relationship, ["concept_id_1", "relationship_id", "concept_id_2"], EDGE),
            relationship.select(*flags).dropna(subset=["relationship_id"]).dropDuplicates(["relationship_id"]),
            ancestors,
            concept_synonym.select(*SYNONYM).dropna().distinct(),
        )

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> VocabularyTables:
        """Files or folders ``<folder>/<table>.parquet``."""
        return cls.from_frames(*[spark.read.parquet(f"{folder}/{name}.parquet") for name in NAMES])

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, *, schema: str | None = None, connect_timeout: int = 10, options: dict[str, str] | None = None) -> VocabularyTables:
        """Tables of a database. ``connect_timeout`` (seconds) is passed on except to SQLite, which has none."""
        given = {"url": url} | ({} if url.startswith("jdbc:sqlite") else {"connectTimeout": str(connect_timeout)}) | (options or {})
        prefix = f"{schema}." if schema else ""
        return cls.from_frames(*[spark.read.format("jdbc").options(**given, dbtable=prefix + name).load() for name in NAMES])

    def cut(self, scratch: Scratch, *names: str) -> VocabularyTables:
        """The same with the tables ``names`` written, for plans that read them often: each reading would bring them to one row per key again."""
        return replace(self, **{name: scratch.cut(getattr(self, name), name) for name in names})

    def write(self, folder: str, mode: str = "errorifexists") -> None:
        """The cleaned tables as Parquet, readable by ``from_parquet``."""
        for name in NAMES:
            getattr(self, name).write.mode(mode).parquet(f"{folder}/{name}.parquet")
