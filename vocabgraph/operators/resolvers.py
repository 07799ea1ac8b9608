"""Terms resolved to candidate concepts by a pipeline of resolvers."""

from __future__ import annotations

from enum import IntEnum
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import similarity
from ..sources.tables import VocabularyTables
from .labels import label_lookup, synonym_lookup


class ResolverConfidence(IntEnum):
    EXACT = 0
    PARTIAL = 1
    EMBEDDING = 2
    EXTERNAL = 3


class CandidateResolver(Protocol):
    """The extension point: ``resolve`` gives (term_id, concept_id, hit_no), hit_no counting from 1 within a term."""

    name: str
    confidence: ResolverConfidence

    def resolve(self, tables: VocabularyTables, terms: DataFrame, *, limit: int | None = None) -> DataFrame: ...


def _numbered(matches: DataFrame, order: list, limit: int | None) -> DataFrame:
    out = matches.withColumn("hit_no", F.row_number().over(Window.partitionBy("term_id").orderBy(*order)))
    return (out.where(F.col("hit_no") <= limit) if limit else out).select("term_id", "concept_id", "hit_no")


class ExactLabelResolver:
    name = "exact_label"
    confidence = ResolverConfidence.EXACT
    lookup = staticmethod(label_lookup)

    def resolve(self, tables: VocabularyTables, terms: DataFrame, *, limit: int | None = None) -> DataFrame:
        """Hits by concept_id. A limit of None or 0 is none."""
        return _numbered(self.lookup(tables, terms), ["concept_id", "matched_label"], limit)


class ExactSynonymResolver(ExactLabelResolver):
    name = "exact_synonym"
    lookup = staticmethod(synonym_lookup)


class PartialLabelResolver:
    name = "partial_label"
    confidence = ResolverConfidence.PARTIAL

    def __init__(self, *, escape: bool = False):
        self.escape = escape

    def resolve(self, tables: VocabularyTables, terms: DataFrame, *, limit: int | None = None) -> DataFrame:
        """Names that contain the term, the most similar to the raw text first."""
        matches = label_lookup(tables, terms, fuzzy=True, escape=self.escape).join(terms.select("term_id", "text"), "term_id")
        return _numbered(matches, [similarity(F.col("text"), F.col("matched_label")), "concept_id"], limit)


class ResolverPipeline:
    """Resolvers in order; a concept keeps its first hit. A resolver is skipped for terms that have hits already if its confidence lies beyond ``stop_after``."""

    def __init__(self, resolvers: list[CandidateResolver], stop_after: ResolverConfidence | None = None):
        self.resolvers = resolvers
        self.stop_after = stop_after

    def resolve(self, tables: VocabularyTables, terms: DataFrame, *, limit: int | None = None) -> DataFrame:
        """(term_id, concept_id, resolver, hit_no), hit_no over the whole pipeline."""
        parts = [r.resolve(tables, terms, limit=limit).select("term_id", "concept_id", "hit_no", F.lit(n).alias("stage"), F.lit(r.name).alias("resolver")) for n, r in enumerate(self.resolvers)]
        hits = reduce(DataFrame.unionByName, parts)
        allowed = hits
        if self.stop_after is not None:
            # a term whose first hits come from stage f ends before the next stage beyond the limit
            beyond = [n for n, r in enumerate(self.resolvers) if r.confidence > self.stop_after]
            ends = [min((n for n in beyond if n > f), default=len(parts)) for f in range(len(parts))]
            first = F.min("stage").over(Window.partitionBy("term_id"))
            allowed = hits.withColumn("_end", F.array(*map(F.lit, ends))[first]).where("stage < _end")
        own = allowed.groupBy("term_id", "concept_id").agg(F.min(F.struct("stage", "hit_no", "resolver")).alias("best"))
        order = Window.partitionBy("term_id").orderBy("best.stage", "best.hit_no", "concept_id")
        return own.select("term_id", "concept_id", F.col("best.resolver").alias("resolver"), F.row_number().over(order).alias("hit_no"))
