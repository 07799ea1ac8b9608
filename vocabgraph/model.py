"""Small values for single results on the driver. The names of classes and fields are the public data model."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class ConceptView:
    concept_id: int
    concept_name: str | None
    concept_code: str | None
    vocabulary_id: str | None
    domain_id: str | None
    concept_class_id: str | None
    standard_concept: str | None
    valid_start_date: date | None
    valid_end_date: date | None
    invalid_reason: str | None


@dataclass(frozen=True)
class EdgeView:
    subject_id: int
    predicate_id: str
    object_id: int
    valid_start_date: date | None = None
    valid_end_date: date | None = None
    invalid_reason: str | None = None


@dataclass(frozen=True)
class Predicate:
    relationship_id: str
    name: str
    reverse_id: str | None
    is_hierarchical: bool
    defines_ancestry: bool
    kind: str


@dataclass(frozen=True)
class LabelMatch:
    input_label: str
    matched_label: str
    concept_id: int
    match_kind: str
    is_standard: bool
    is_active: bool

    def rank(self) -> tuple[bool, bool, bool]:
        return not self.is_standard, not self.is_active, self.match_kind == "SYNONYM"

    def __lt__(self, other: LabelMatch) -> bool:
        return self.rank() < other.rank()


@dataclass(frozen=True)
class Subgraph:
    nodes: frozenset[int]
    edges: tuple[EdgeView, ...]


@dataclass(frozen=True)
class TraceStep:
    depth: int
    node: int
    expanded_edges: tuple[EdgeView, ...]


@dataclass(frozen=True)
class GraphTrace:
    seeds: tuple[int, ...]
    steps: tuple[TraceStep, ...]
    terminated_reason: str | None = None


@dataclass(frozen=True)
class PathStep:
    subject: int
    predicate: str
    object: int


@dataclass(frozen=True)
class GraphPath:
    steps: tuple[PathStep, ...]

    def nodes(self) -> tuple[int, ...]:
        return (self.steps[0].subject, *(s.object for s in self.steps)) if self.steps else ()


@dataclass(frozen=True)
class PathProfile:
    invalid_concepts: int = 0
    non_standard_concepts: int = 0
    metadata_edges: int = 0
    mapping_edges: int = 0
    vocabulary_switches: int = 0
    hops: int = 0
    ontological_edges: int = 0

    def path_rank(self) -> tuple[int, ...]:
        return self.invalid_concepts, self.non_standard_concepts, self.metadata_edges, self.mapping_edges, self.vocabulary_switches, self.hops, -self.ontological_edges

    def __lt__(self, other: PathProfile) -> bool:
        return self.path_rank() < other.path_rank()


@dataclass(frozen=True)
class PathExplanationStep:
    step: PathStep
    traversal_depth: int | None
    kind: str | None
    reason: str | None


@dataclass(frozen=True)
class PathExplanation:
    path: GraphPath
    profile: PathProfile
    steps: tuple[PathExplanationStep, ...]


@dataclass(frozen=True)
class CandidateHit:
    concept_id: int
    resolver: str


@dataclass(frozen=True)
class GroundingCandidate:
    concept_id: int
    label: str | None
    best_path_profile: PathProfile
    paths: tuple[GraphPath, ...]


@dataclass(frozen=True)
class ParentStatistics:
    """``descendants`` and ``found`` are held on the driver: for large groups use the frames of ``common_parents``."""

    descendants: frozenset[int]
    found: frozenset[int]
    coverage: int
    pollution: int
    purity: float
    completeness: float
    max_depth: int
