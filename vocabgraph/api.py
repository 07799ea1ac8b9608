"""The public names."""

from .functions.columns import KINDS, PredicateKind
from .graph import GraphBackend, KnowledgeGraph
from .model import CandidateHit, ConceptView, EdgeView, GraphPath, GraphTrace, GroundingCandidate, LabelMatch, ParentStatistics, PathExplanation, PathProfile, PathStep, Predicate, Subgraph
from .operators.edges import EdgeFilter
from .operators.grounding import GroundingConstraints, ground_terms
from .operators.paths import shortest_paths
from .operators.phenotype import common_parents, greedy_cover, parent_search, relate_groups, standardise_ids, subsumes_closure
from .operators.resolvers import CandidateResolver, ExactLabelResolver, ExactSynonymResolver, PartialLabelResolver, ResolverConfidence, ResolverPipeline
from .operators.scoring import explain, path_profile, path_rank, rank_paths, ranked_paths_with_explanations
from .operators.traverse import traverse
from .sources.tables import VocabularyTables

__all__ = [
    "KINDS", "CandidateHit", "CandidateResolver", "ConceptView", "EdgeFilter", "EdgeView", "ExactLabelResolver", "ExactSynonymResolver", "GraphBackend", "GraphPath", "GraphTrace", "GroundingCandidate", "GroundingConstraints", "KnowledgeGraph", "LabelMatch", "ParentStatistics", "PartialLabelResolver", "PathExplanation", "PathProfile", "PathStep",
    "Predicate", "PredicateKind", "ResolverConfidence", "ResolverPipeline", "Subgraph", "VocabularyTables", "common_parents", "explain", "greedy_cover", "ground_terms", "parent_search", "path_profile", "path_rank", "rank_paths", "ranked_paths_with_explanations", "relate_groups", "shortest_paths", "standardise_ids", "subsumes_closure", "traverse",
]
