"""The graph façade: scalar calls answered by the batch operators, and the batch operators as methods."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import CandidateHit, ConceptView, EdgeView, GraphPath, GraphTrace, GroundingCandidate, LabelMatch, ParentStatistics, PathExplanation, PathExplanationStep, PathProfile, PathStep, Predicate, Subgraph, TraceStep
from .operators import edges as E
from .operators import hierarchy as H
from .operators import labels as L
from .operators import lookup as K
from .operators import phenotype as P
from .operators.grounding import GroundingConstraints, ground_terms
from .operators.paths import ShortestPaths, shortest_paths
from .operators.resolvers import ResolverPipeline
from .operators.scoring import COUNTERS, explain, path_profile, rank_paths
from .operators.traverse import Traversal, traverse
from .sources.tables import CONCEPT, VocabularyTables


class GraphBackend(Protocol):
    """What the renderers and scalar algorithms need of a graph."""

    def concept_view(self, concept_id: int) -> ConceptView: ...
    def predicate_kind(self, relationship_id: str) -> str: ...
    def predicate_name(self, relationship_id: str) -> str: ...
    def reverse_predicate_id(self, relationship_id: str) -> str | None: ...
    def iter_edges(self, concept_id: int, **rule) -> Iterable[EdgeView]: ...
    def clear_caches(self) -> None: ...


class KnowledgeGraph:
    """Vocabulary tables seen as a graph.

    ``edges`` is the enriched edge frame; ``persist`` keeps it and the concepts in memory for many scalar calls. Predicates, a
    fixed small table, are held on the driver after the first use. Scalar methods run one small Spark job each: for many
    ids use the operators with frames.
    """

    def __init__(self, tables: VocabularyTables):
        self.tables = tables
        self.edges = E.enriched_edges(tables)
        self._predicates: dict[str, Predicate] | None = None

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> KnowledgeGraph:
        return cls(VocabularyTables.from_parquet(spark, folder))

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def persist(self) -> KnowledgeGraph:
        self.edges.persist()
        self.tables.concept.persist()
        return self

    def clear_caches(self) -> None:
        self.edges.unpersist()
        self.tables.concept.unpersist()
        self._predicates = None

    def rollback_session(self) -> None:
        """Spark has no transactions: nothing to roll back."""

    def _ids(self, ids: Iterable[int], name: str = "concept_id") -> DataFrame:
        return self.spark.createDataFrame([(int(i),) for i in ids], f"{name} bigint")

    def _node(self, node: int) -> DataFrame:
        return self.spark.createDataFrame([(0, int(node))], "query_id bigint, node bigint")

    # nodes and predicates
    def concept_views(self, ids: Iterable[int]) -> list[ConceptView]:
        return [ConceptView(*r) for r in K.concept_view(self.tables, self._ids(ids), strict=True).select(*CONCEPT).collect()]

    def concept_view(self, concept_id: int) -> ConceptView:
        return self.concept_views([concept_id])[0]

    def concept_id_by_code(self, vocabulary_id: str, concept_code: str) -> int:
        asked = self.spark.createDataFrame([(vocabulary_id, concept_code)], "vocabulary_id string, concept_code string")
        return K.concept_id_by_code(self.tables, asked, strict=True).first()["concept_id"]

    def predicate(self, relationship_id: str) -> Predicate:
        if self._predicates is None:
            rows = K.predicates(self.tables).collect()
            self._predicates = {r.predicate_id: Predicate(r.predicate_id, r["name"], r.reverse_id, r.is_hierarchical, r.defines_ancestry, r.kind) for r in rows}
        if relationship_id not in self._predicates:
            raise K.NotExactlyOne(f"no predicate {relationship_id!r}")
        return self._predicates[relationship_id]

    def predicate_name(self, relationship_id: str) -> str:
        return self.predicate(relationship_id).name

    def predicate_kind(self, relationship_id: str) -> str:
        return self.predicate(relationship_id).kind

    def reverse_predicate_id(self, relationship_id: str) -> str | None:
        return self.predicate(relationship_id).reverse_id

    def synonyms_for_concept(self, concept_id: int) -> tuple[str, ...]:
        rows = K.synonyms_of(self.tables, self._ids([concept_id])).collect()
        return tuple(sorted(r.concept_synonym_name for r in rows))

    # edges
    @staticmethod
    def _views(rows: DataFrame) -> tuple[EdgeView, ...]:
        found = [EdgeView(r.subject_id, r.predicate_id, r.object_id, r.valid_start_date, r.valid_end_date, r.invalid_reason) for r in rows.collect()]
        return tuple(sorted(found, key=lambda e: (e.subject_id, e.predicate_id, e.object_id)))

    def outgoing_edges(self, concept_id: int, relationship_id: str | None = None) -> tuple[EdgeView, ...]:
        return self._views(E.outgoing_edges(self.edges, self._node(concept_id), relationship_id))

    def incoming_edges(self, concept_id: int, relationship_id: str | None = None) -> tuple[EdgeView, ...]:
        return self._views(E.incoming_edges(self.edges, self._node(concept_id), relationship_id))

    def iter_edges(self, concept_id: int, *, direction: str = "out", predicate=None, predicate_kinds: Iterable[str] | None = None, active_only: bool = True, on: date | None = None, within_domain: bool = True) -> tuple[EdgeView, ...]:
        rule = E.EdgeFilter(predicate, E.kinds_tuple(predicate_kinds), active_only, on, within_domain)
        return self._views(E.iter_edges(self.edges, self._node(concept_id), rule, direction=direction))

    # hierarchy
    def parents(self, concept_id: int) -> tuple[int, ...]:
        return tuple(sorted(r.relative_id for r in H.parents(self.tables, self._ids([concept_id])).collect()))

    def roots(self, domain_id: str | None = None, vocabulary_id: str | None = None) -> DataFrame:
        return H.roots(self.tables, domain_id=domain_id, vocabulary_id=vocabulary_id)

    def leaves(self, domain_id: str | None = None, vocabulary_id: str | None = None) -> DataFrame:
        return H.leaves(self.tables, domain_id=domain_id, vocabulary_id=vocabulary_id)

    def singletons(self, domain_id: str | None = None, vocabulary_id: str | None = None) -> DataFrame:
        return H.singletons(self.tables, domain_id=domain_id, vocabulary_id=vocabulary_id)

    # labels
    def _term(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text)], "term_id bigint, text string")

    def label_lookup(self, label: str, fuzzy: bool = False) -> tuple[LabelMatch, ...]:
        rows = L.ranked_labels(L.label_lookup(self.tables, self._term(label), fuzzy=fuzzy)).orderBy("rank_no").collect()
        return tuple(LabelMatch(r.input_label, r.matched_label, r.concept_id, r.match_kind, r.is_standard, r.is_active) for r in rows)

    def synonym_lookup(self, label: str, fuzzy: bool = False) -> tuple[LabelMatch, ...]:
        rows = L.ranked_labels(L.synonym_lookup(self.tables, self._term(label), fuzzy=fuzzy)).orderBy("rank_no").collect()
        return tuple(LabelMatch(r.input_label, r.matched_label, r.concept_id, r.match_kind, r.is_standard, r.is_active) for r in rows)

    def concept_ids_by_label(self, label: str) -> tuple[int, ...]:
        return tuple(sorted(r.concept_id for r in L.concept_ids_by_label(self.tables, self._term(label)).collect()))

    # traversal and paths
    def traverse(self, seeds: Iterable[int], *, predicate_kinds: Iterable[str] | None = None, max_depth: int, on: date | None = None, max_nodes: int | None = None) -> tuple[Subgraph, GraphTrace]:
        seeds = list(dict.fromkeys(seeds))
        rows = self.spark.createDataFrame([(0, int(s)) for s in seeds], "query_id bigint, node bigint")
        found: Traversal = traverse(self.edges, rows, rule=E.EdgeFilter(kinds=E.kinds_tuple(predicate_kinds), on=on), max_depth=max_depth, max_nodes=max_nodes)
        steps: dict[int, tuple[int, int, list]] = {}
        for r in found.trace.orderBy("step_no", "predicate_id", "object_id").collect():
            own = steps.setdefault(r.step_no, (r.depth, r.node, []))
            if r.subject_id is not None:
                own[2].append(EdgeView(r.subject_id, r.predicate_id, r.object_id, r.valid_start_date, r.valid_end_date, r.invalid_reason))
        graph = Subgraph(frozenset(r.node for r in found.nodes.select("node").collect()), self._views(found.edges))
        return graph, GraphTrace(tuple(seeds), tuple(TraceStep(d, n, tuple(e)) for d, n, e in steps.values()), found.summary.first()["terminated_reason"])

    def _pair(self, source: int, target: int) -> DataFrame:
        return self.spark.createDataFrame([(0, int(source), int(target))], "pair_id bigint, source bigint, target bigint")

    def _search(self, source: int, target: int, predicate_kinds, max_depth: int, on: date | None, max_paths: int) -> ShortestPaths:
        return shortest_paths(self.edges, self._pair(source, target), rule=E.EdgeFilter(kinds=E.kinds_tuple(predicate_kinds), on=on), max_depth=max_depth, max_paths=max_paths)

    def find_shortest_paths(self, source: int, target: int, *, predicate_kinds: Iterable[str] | None = None, max_depth: int = 6, on: date | None = None, max_paths: int = 20, traced: bool = False) -> tuple[list[GraphPath], GraphTrace | None]:
        found = self._search(source, target, predicate_kinds, max_depth, on, max_paths)
        paths = [GraphPath(tuple(PathStep(s.subject, s.predicate, s.object) for s in r.steps)) for r in found.paths.orderBy("path_no").collect()]
        if not traced:
            return paths, None
        steps: dict[tuple, list] = {}
        rows = found.trace.orderBy("depth", "side", "node", "predicate_id", "object_id").collect()
        for r in rows:
            steps.setdefault((r.depth, r.side, r.node), []).append(EdgeView(r.subject_id, r.predicate_id, r.object_id))
        return paths, GraphTrace((source,), tuple(TraceStep(d, n, tuple(e)) for (d, _, n), e in steps.items()), found.summary.first()["reason"])

    def find_ranked_paths_with_explanations(self, source: int, target: int, *, predicate_kinds: Iterable[str] | None = None, max_depth: int = 6, on: date | None = None, max_paths: int = 20) -> list[PathExplanation]:
        found = self._search(source, target, predicate_kinds, max_depth, on, max_paths)
        ranked = rank_paths(path_profile(self.tables, found.paths))
        told: dict[int, list] = {}
        for r in explain(self.tables, ranked, found.expansions).orderBy("path_no", "step_no").collect():
            told.setdefault(r.path_no, []).append(PathExplanationStep(PathStep(r.subject, r.predicate, r.object), r.traversal_depth, r.kind, r.reason))
        out = []
        for r in ranked.orderBy("rank_no").collect():
            path = GraphPath(tuple(PathStep(s.subject, s.predicate, s.object) for s in r.steps))
            out.append(PathExplanation(path, PathProfile(*[r[c] for c in COUNTERS]), tuple(told.get(r.path_no, ()))))
        return out

    def path_profile(self, path: GraphPath) -> PathProfile:
        steps = [(s.subject, s.predicate, s.object) for s in path.steps]
        rows = self.spark.createDataFrame([(0, 1, len(steps), steps)], "pair_id bigint, path_no int, hops int, steps array<struct<subject:bigint,predicate:string,object:bigint>>")
        r = path_profile(self.tables, rows).first()
        return PathProfile(*[r[c] for c in COUNTERS])

    def rank_paths(self, paths: list[GraphPath]) -> list[tuple[GraphPath, PathProfile]]:
        """Stable: ties keep their order."""
        return sorted(((p, self.path_profile(p)) for p in paths), key=lambda x: x[1].path_rank())

    # reasoning
    def resolve(self, text: str, pipeline: ResolverPipeline, *, limit_per_resolver: int | None = None) -> list[CandidateHit]:
        rows = pipeline.resolve(self.tables, self._term(text), limit=limit_per_resolver).orderBy("hit_no").collect()
        return [CandidateHit(r.concept_id, r.resolver) for r in rows]

    def ground_term(self, text: str, *, constraints: GroundingConstraints, resolver_pipeline: ResolverPipeline) -> list[GroundingCandidate]:
        rows = ground_terms(self.tables, self.edges, self._term(text), resolver_pipeline, constraints).orderBy("rank_no").collect()
        path = lambda steps: GraphPath(tuple(PathStep(s.subject, s.predicate, s.object) for s in steps))
        return [GroundingCandidate(r.concept_id, r.label, PathProfile(*[r[c] for c in COUNTERS]), tuple(map(path, r.paths))) for r in rows]

    def standardise_ids(self, ids: Iterable[int]) -> dict[int, int]:
        return {r.concept_id: r.standard_id for r in P.standardise_ids(self.edges, self._ids(ids)).collect()}

    def parent_search(self, concept_id: int) -> set[int]:
        return {r.parent_id for r in P.parent_search(self.edges, self._ids([concept_id])).collect()}

    def descendants(self, root_id: int, exclude_roots: Iterable[int] = ()) -> set[int]:
        """The 'Subsumes' closure of one root, not passing ``exclude_roots``."""
        root = self.spark.createDataFrame([(0, int(root_id))], "group_id bigint, root bigint")
        barriers = self.spark.createDataFrame([(0, int(i)) for i in exclude_roots], "group_id bigint, node bigint")
        return {r.node for r in P.subsumes_closure(self.edges, root, barriers).collect()}

    def _seeds(self, seeds: Iterable[int]) -> DataFrame:
        return self.spark.createDataFrame([(0, int(s)) for s in seeds], "group_id bigint, concept_id bigint")

    def find_common_parents(self, seeds: Iterable[int], *, min_coverage: int = 2, max_up_depth: int | None = None, standardise_seeds: bool = False) -> dict[int, ParentStatistics]:
        found = P.common_parents(self.edges, self._seeds(seeds), min_coverage=min_coverage, max_up_depth=max_up_depth, standardise_seeds=standardise_seeds)
        gather = lambda df, column: {r.parent_id: frozenset(r.x) for r in df.groupBy("parent_id").agg(F.collect_set(column).alias("x")).collect()}
        below, met = gather(found.descendants, "node"), gather(found.found, "origin")
        return {r.parent_id: ParentStatistics(below[r.parent_id], met[r.parent_id], r.coverage, r.pollution, r.purity, r.completeness, r.max_depth) for r in found.stats.collect()}

    def _parents_frame(self, candidates: dict[int, ParentStatistics]) -> P.CommonParents:
        stats = [(0, i, c.coverage, c.pollution, c.purity, c.completeness, c.max_depth) for i, c in candidates.items()]
        pairs = lambda field: self.spark.createDataFrame([(0, i, n) for i, c in candidates.items() for n in getattr(c, field)], f"group_id bigint, parent_id bigint, {'origin' if field == 'found' else 'node'} bigint")
        return P.CommonParents(self.spark.createDataFrame(stats, "group_id bigint, parent_id bigint, coverage bigint, pollution bigint, purity double, completeness double, max_depth int"), pairs("found"), pairs("descendants"))

    def greedy_parent_cover(self, seeds: Iterable[int], candidates: dict[int, ParentStatistics], *, target_coverage_ratio: float = 1.0, alpha: float = 1.0, beta: float = 1.0, gamma: float = 0.3, delta: float = 0.7, min_gain: int = 1) -> list[int]:
        picks = P.greedy_cover(self._seeds(seeds), self._parents_frame(candidates), target_ratio=target_coverage_ratio, alpha=alpha, beta=beta, gamma=gamma, delta=delta, min_gain=min_gain)
        return [r.parent_id for r in picks.orderBy("pick_no").collect()]

    def relate_groups(self, candidates: dict[int, ParentStatistics]) -> list[dict]:
        rows = P.relate_groups(self._parents_frame(candidates)).orderBy("from_id", "to_id").collect()
        return [{"type": r.type, "from": r.from_id, "to": r.to_id, "overlap": r.overlap} for r in rows]
