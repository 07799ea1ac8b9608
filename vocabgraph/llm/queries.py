"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .canonical import map_names
from .groups import match_groups
from .leakage import find_leaks
from .lookalike import inconsistent, with_comparable
from .mixing import mix
from .quality import STATS, page_kinds
from .sql import ORACLE

TIES = ["Maps to", "Mapped from", "Same as", "Replaced by", "Replaces"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin_table, concept_id, name) of both name columns, distinct, null names and ids left out."""
    concepts = _read(spark, sf_dir, "concept").select(F.lit("concept").alias("origin_table"), "concept_id", F.col("concept_name").alias("name"))
    synonyms = _read(spark, sf_dir, "concept_synonym").select(F.lit("concept_synonym").alias("origin_table"), "concept_id", F.col("concept_synonym_name").alias("name"))
    return concepts.unionByName(synonyms).where("concept_id IS NOT NULL AND name IS NOT NULL")


def _typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin_table, concept_id, name): the freely typed names of 'SITE' concepts and their synonyms."""
    concepts = _read(spark, sf_dir, "concept").where("vocabulary_id = 'SITE'")
    own = concepts.select(F.lit("concept").alias("origin_table"), "concept_id", F.col("concept_name").alias("name"))
    synonyms = _read(spark, sf_dir, "concept_synonym").join(concepts.select("concept_id").distinct(), "concept_id", "left_semi")
    both = own.unionByName(synonyms.select(F.lit("concept_synonym").alias("origin_table"), "concept_id", F.col("concept_synonym_name").alias("name")))
    return both.where("concept_id IS NOT NULL AND name IS NOT NULL").distinct()


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed_names(spark, sf_dir)
    return rows.join(map_names(rows, "name", _read(spark, sf_dir, "canonical_name")).withColumnRenamed("text", "name"), "name")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).where("entry_id IS NOT NULL").select("origin_table", "concept_id", F.col("entry_id").alias("canonical_id")).distinct()


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed names that mean no entry, or several equally well, with how often each occurs."""
    rest = _mapped(spark, sf_dir).where("entry_id IS NULL")
    return rest.groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"), F.max("n_closest").cast("long").alias("n_closest"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _read(spark, sf_dir, "concept").select("concept_id").distinct()
    rows = _read(spark, sf_dir, "concept_relationship").where(F.col("relationship_id").isin(TIES) & F.col("invalid_reason").isNull()).select("concept_id_1", "concept_id_2").distinct()
    ties = rows.join(ids.withColumnRenamed("concept_id", "concept_id_1"), "concept_id_1", "left_semi").join(ids.withColumnRenamed("concept_id", "concept_id_2"), "concept_id_2", "left_semi")
    return match_groups(ties, "concept_id_1", "concept_id_2").select("group_id", F.col("member").alias("concept_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inconsistent(_all_names(spark, sf_dir), "name").select("origin_table", "concept_id").distinct()


def p4_equal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparable forms that several different spellings share: the names made equal."""
    forms = with_comparable(_all_names(spark, sf_dir).select("name").distinct(), "name")
    return forms.groupBy("comparable").agg(F.count(F.lit(1)).alias("n_spellings"), F.min("name").alias("first_spelling")).where("n_spellings > 1")



def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_item")).select("item_id", "doc_id").distinct()


def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation item: how many pages hold it and the longest run."""
    leaks = find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_item"))
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_pages"), F.max("run").cast("long").alias("longest_run"))



def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the mix with their copies."""
    pages, _ = mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "source_target"))
    return pages.select("doc_id", "source", "n_tokens", F.col("copies").cast("long").alias("copies"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share per source."""
    _, shares = mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "source_target"))
    return shares


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_kinds(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "common_word"), _read(spark, sf_dir, "page_label"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).where("page_class <> 'prose'").select("doc_id", "page_class").distinct()


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).select("doc_id", *[F.round(s, 6).alias(s) for s in STATS], "page_class")


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p3_found, p4_found, p4_equal_names, p7_found, p7_leaked_items, p8_mix, p8_shares, p9_found, p9_statistics)}
