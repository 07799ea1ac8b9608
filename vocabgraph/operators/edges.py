"""Edges enriched once with kind and domains, and one filter for every way to expand nodes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_active
from ..sources.tables import VocabularyTables
from .lookup import predicates

EDGE_COLUMNS = ["subject_id", "predicate_id", "object_id", "kind", "valid_start_date", "valid_end_date", "invalid_reason"]


def enriched_edges(tables: VocabularyTables) -> DataFrame:
    """(EDGE_COLUMNS, subject_domain, object_domain, dangling): every relationship row with the kind of its predicate and both domains.

    Rows whose ends are not concepts, or whose predicate is unknown, are kept and marked ``dangling``; filters by domain drop
    them. Catalyst broadcasts the predicates by their size; the two concept joins carry two columns each.
    """
    edges = tables.concept_relationship.select(F.col("concept_id_1").alias("subject_id"), F.col("relationship_id").alias("predicate_id"), F.col("concept_id_2").alias("object_id"), "valid_start_date", "valid_end_date", "invalid_reason")
    kinds = predicates(tables).select("predicate_id", "kind")
    place = tables.concept.select("concept_id", "domain_id", F.lit(True).alias("known"))
    subject = place.toDF("subject_id", "subject_domain", "_s")
    object_ = place.toDF("object_id", "object_domain", "_o")
    out = edges.join(kinds, "predicate_id", "left").join(subject, "subject_id", "left").join(object_, "object_id", "left")
    return out.select(*EDGE_COLUMNS, "subject_domain", "object_domain", (F.col("_s").isNull() | F.col("_o").isNull() | F.col("kind").isNull()).alias("dangling"))


def predicate_key(predicate) -> str | None:
    """None, an id, or anything with a ``relationship_id``; TypeError for the rest."""
    if predicate is None or isinstance(predicate, str):
        return predicate
    key = getattr(predicate, "relationship_id", None)
    if isinstance(key, str):
        return key
    raise TypeError(f"not a predicate: {type(predicate).__name__}")


@dataclass(frozen=True)
class EdgeFilter:
    """Which edges may be followed. ``kinds`` empty or None: any; ``on``: a day on which they must be valid."""

    predicate: object = None
    kinds: tuple[str, ...] | None = None
    active_only: bool = True
    on: date | None = None
    within_domain: bool = True

    def condition(self) -> Column:
        out = F.lit(True)
        key = predicate_key(self.predicate)
        if key is not None:
            out = out & (F.col("predicate_id") == key)
        if self.active_only:
            out = out & is_active(F.col("valid_start_date"), F.col("valid_end_date"), F.col("invalid_reason"), self.on)
        if self.within_domain:
            out = out & ~F.col("dangling") & F.col("subject_domain").eqNullSafe(F.col("object_domain"))
        if self.kinds:
            out = out & F.col("kind").isin(*self.kinds)
        return out


def kinds_tuple(kinds: Iterable[str] | None) -> tuple[str, ...] | None:
    return tuple(sorted(str(k) for k in kinds)) if kinds else None


def iter_edges(edges: DataFrame, nodes: DataFrame, rule: EdgeFilter, *, direction: str = "out", strict: bool = False) -> DataFrame:
    """Edges of ``nodes`` (query_id, node) that pass ``rule``: (query_id, EDGE_COLUMNS). Any direction but 'out' means incoming.

    ``edges``: enriched. With ``strict`` an edge to an unknown concept raises where domains are compared; else it is dropped there.
    """
    end = "subject_id" if direction == "out" else "object_id"
    own = nodes.select("query_id", F.col("node").alias(end)).dropna(subset=[end]).distinct()
    near = edges.join(own, end)
    if strict and rule.within_domain and not near.where("dangling").isEmpty():
        raise LookupError("an edge refers to an unknown concept or predicate")
    return near.where(rule.condition()).select("query_id", *EDGE_COLUMNS)


def outgoing_edges(edges: DataFrame, nodes: DataFrame, predicate=None) -> DataFrame:
    """All edges from ``nodes``, valid or not, optionally of one predicate."""
    return iter_edges(edges, nodes, EdgeFilter(predicate=predicate, active_only=False, within_domain=False))


def incoming_edges(edges: DataFrame, nodes: DataFrame, predicate=None) -> DataFrame:
    """All edges to ``nodes``, valid or not, optionally of one predicate."""
    return iter_edges(edges, nodes, EdgeFilter(predicate=predicate, active_only=False, within_domain=False), direction="in")
