"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import date
from enum import StrEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

ONTOLOGICAL, ATTRIBUTE, MAPPING, VERSIONING, METADATA = "ONTOLOGICAL", "ATTRIBUTE", "MAPPING", "VERSIONING", "METADATA"
KINDS = (ONTOLOGICAL, ATTRIBUTE, MAPPING, VERSIONING, METADATA)

# What a kind of predicate is called in explanations.
KIND_LABELS = {
    ONTOLOGICAL: "ontological relationship (preferred structure)",
    MAPPING: "mapping relationship (cross-vocabulary)",
    ATTRIBUTE: "attribute enrichment",
    VERSIONING: "versioning relationship",
    METADATA: "metadata relationship (low semantic value)",
}


class PredicateKind(StrEnum):
    ONTOLOGICAL = ONTOLOGICAL
    ATTRIBUTE = ATTRIBUTE
    MAPPING = MAPPING
    VERSIONING = VERSIONING
    METADATA = METADATA

    def label(self) -> str:
        return KIND_LABELS[self.value]


def predicate_kind(name: Column, hierarchical: Column, ancestry: Column) -> Column:
    """The kind of a predicate by its flags, else by its name; a null name is METADATA."""
    low = F.lower(name)
    return (
        F.when(F.coalesce(hierarchical, F.lit(False)) | F.coalesce(ancestry, F.lit(False)), ONTOLOGICAL)
        .when(low.contains("maps to") | low.contains("mapped from") | low.contains("equivalent"), MAPPING)
        .when(low.contains("replaced") | low.contains("replaces"), VERSIONING)
        .when(low.startswith("has "), ATTRIBUTE)
        .otherwise(METADATA)
    )


def kind_label(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in KIND_LABELS.items() for x in pair])[kind]


def is_active(start: Column, end: Column, invalid_reason: Column, on: date | None = None) -> Column:
    """Without a date validity alone counts; with one it must lie within the bounds, null bounds being open."""
    valid = invalid_reason.isNull()
    if on is None:
        return valid
    day = F.lit(on)
    return valid & (start.isNull() | (start <= day)) & (end.isNull() | (day <= end))


def normalise_label(text: Column) -> Column:
    """Trimmed, lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def label_is_standard(standard: Column) -> Column:
    return F.coalesce(standard.isin("S", "C"), F.lit(False))


def label_is_active(invalid_reason: Column) -> Column:
    return ~F.coalesce(invalid_reason.isin("D", "U"), F.lit(False))


def label_rank(standard: Column, active: Column, match_kind: Column) -> Column:
    """Struct that orders standard before non-standard, active before inactive, direct before synonym."""
    return F.struct((~standard).alias("a"), (~active).alias("b"), (match_kind == "SYNONYM").alias("c"))


def similarity(query: Column, label: Column) -> Column:
    """Struct, least first: does not start with the query, blanks in the label, difference in length; on the raw lower-case texts."""
    q, x = F.lower(query), F.lower(label)
    return F.struct((~x.startswith(q)).alias("a"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).alias("b"), F.abs(F.length(x) - F.length(q)).alias("c"))
