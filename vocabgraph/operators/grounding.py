"""Terms grounded to concepts that satisfy constraints and hang below given parents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ONTOLOGICAL
from ..scratch import Scratch
from ..sources.tables import VocabularyTables
from .edges import EdgeFilter
from .paths import paths_to_targets
from .resolvers import ResolverPipeline
from .scoring import COUNTERS, path_profile, path_rank

PATHS_PER_PARENT = 3


@dataclass(frozen=True)
class GroundingConstraints:
    """``upward_only``: count 'Is a' links only, so that siblings and descendants of a parent don't pass."""

    parent_ids: tuple[int, ...]
    allowed_domains: frozenset[str] = field(default_factory=frozenset)
    allowed_vocabularies: frozenset[str] | None = None
    require_standard: bool = False
    max_depth: int = 6
    upward_only: bool = False


def passes_constraints(tables: VocabularyTables, hits: DataFrame, constraints: GroundingConstraints) -> DataFrame:
    """The ``hits`` whose concept has an allowed domain and vocabulary and, if required, a standard flag; empty sets allow all."""
    rows = tables.concept.select("concept_id", F.col("concept_name").alias("label"), "domain_id", "vocabulary_id", "standard_concept")
    if constraints.allowed_domains:
        rows = rows.where(F.col("domain_id").isin(*constraints.allowed_domains))
    if constraints.allowed_vocabularies:
        rows = rows.where(F.col("vocabulary_id").isin(*constraints.allowed_vocabularies))
    if constraints.require_standard:
        rows = rows.where("standard_concept IS NOT NULL")
    return hits.join(rows.select("concept_id", "label"), "concept_id")


def ground_terms(tables: VocabularyTables, edges: DataFrame, terms: DataFrame, pipeline: ResolverPipeline, constraints: GroundingConstraints) -> DataFrame:
    """(term_id, concept_id, label, COUNTERS of the best path, rank_no, paths) for ``terms`` (term_id, text).

    A concept passes if a path of ontological links leads to one of the parents; it may be the parent itself. Up to three
    paths per parent are kept. Without parents nothing grounds. Ties in rank keep the order of the hits. The parents search back
    once for all terms.
    """
    scratch = Scratch(edges.sparkSession, "grounding")
    hits = scratch.cut(passes_constraints(tables, pipeline.resolve(tables, terms), constraints), "hits")
    parents = list(dict.fromkeys(int(p) for p in constraints.parent_ids))
    targets = hits.sparkSession.createDataFrame([(p,) for p in parents], "target bigint")
    rule = EdgeFilter(predicate="Is a" if constraints.upward_only else None, kinds=(ONTOLOGICAL,))
    found = paths_to_targets(edges, hits.select(F.col("concept_id").alias("source")), targets, rule=rule, max_depth=constraints.max_depth, max_paths=PATHS_PER_PARENT)
    found = found.select(F.struct("source", "target").alias("pair_id"), "path_no", "hops", "steps")
    profiled = path_profile(tables, found).withColumn("concept_id", F.col("pair_id.source"))
    order = {p: n for n, p in enumerate(parents)}
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("pair_id.target")] if order else F.lit(0)
    best = profiled.groupBy("concept_id").agg(F.min_by(F.struct(*COUNTERS), F.struct(path_rank(), place, "path_no")).alias("best"), F.array_sort(F.collect_list(F.struct(place.alias("parent"), "path_no", "steps"))).alias("paths"))
    out = hits.join(best, "concept_id").select("term_id", "concept_id", "label", "hit_no", *[F.col("best")[c].alias(c) for c in COUNTERS], F.transform("paths", lambda x: x["steps"]).alias("paths"))
    return out.withColumn("rank_no", F.row_number().over(Window.partitionBy("term_id").orderBy(path_rank(), "hit_no"))).drop("hit_no")
