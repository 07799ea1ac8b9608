"""Nulls, repeats, empty tables and clashing extra columns in the graph operators."""

from pyspark.sql import functions as F

from tests.conftest import ANCESTOR, CONCEPT, FIRST, LAST, PREDICATE, PREDICATES, RELATION, SYNONYM
from vocabgraph.operators import edges as E
from vocabgraph.operators import hierarchy as H
from vocabgraph.operators import labels as L
from vocabgraph.operators import phenotype as P
from vocabgraph.operators.paths import shortest_paths
from vocabgraph.operators.scoring import path_profile, rank_paths
from vocabgraph.operators.traverse import traverse
from vocabgraph.sources.tables import VocabularyTables


def test_empty(spark, empty_tables):
    edges = E.enriched_edges(empty_tables)
    pairs = spark.createDataFrame([(0, 1, 2), (1, 3, 3), (2, None, 3)], "pair_id long, source long, target long")
    found = shortest_paths(edges, pairs)
    assert {(r.pair_id, r.reason) for r in found.summary.collect()} == {(0, "no_path"), (1, "source_equals_target")}
    assert [r.hops for r in rank_paths(path_profile(empty_tables, found.paths)).collect()] == [0]
    seeds = spark.createDataFrame([(0, None), (1, 5)], "query_id long, node long")
    assert [r.node for r in traverse(edges, seeds, max_depth=2).nodes.collect()] == [5]
    none = spark.createDataFrame([], "group_id long, concept_id long")
    found = P.common_parents(edges, none)
    assert found.stats.count() == 0 and P.greedy_cover(none, found).count() == 0 and P.relate_groups(found).count() == 0
    terms = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "term_id long, text string")
    assert L.label_lookup(empty_tables, terms, fuzzy=True).count() == 0 and H.roots(empty_tables).count() == 0


def test_dirty_rows(spark):
    concept = spark.createDataFrame(
        [(1, "old", "a", "V", "D", "x", "S", FIRST, LAST, None, 1, 9), (1, "new", "a", "V", "D", "x", "S", FIRST, LAST, "D", 2, 9), (2, None, None, None, None, None, None, None, None, None, 1, 9), (None, "ghost", "g", "V", "D", "x", "S", FIRST, LAST, None, 1, 9)],
        CONCEPT + ", loaded_at int, subject_id int",
    )
    relation = spark.createDataFrame([(1, 2, "Related", None, None, None, 1), (1, 2, "Related", None, None, None, 1), (1, 2, "Related", None, None, "D", 3), (1, None, "Related", None, None, None, 1), (1, 9, "Related", None, None, None, 1), (1, 2, "Unheard", None, None, None, 1)], RELATION + ", loaded_at int")
    tables = VocabularyTables.from_frames(concept.withColumn("kind", F.lit("clash")), relation, spark.createDataFrame(PREDICATES, PREDICATE), spark.createDataFrame([(1, 2, 3), (1, 2, 1), (None, 2, 1)], ANCESTOR), spark.createDataFrame([(1, "s"), (1, "s"), (None, "t"), (1, None)], SYNONYM))
    assert {(r.concept_id, r.concept_name) for r in tables.concept.collect()} == {(1, "new"), (2, None)}
    assert {(r.concept_id_2, r.relationship_id, r.invalid_reason) for r in tables.concept_relationship.collect()} == {(2, "Related", "D"), (9, "Related", None), (2, "Unheard", None)}
    assert [tuple(r) for r in tables.concept_ancestor.collect()] == [(1, 2, 1)] and tables.concept_synonym.count() == 1
    edges = E.enriched_edges(tables)
    node = spark.createDataFrame([(0, 1), (0, 1), (0, None)], "query_id long, node long")
    assert {(r.object_id, r.predicate_id) for r in E.outgoing_edges(edges, node).collect()} == {(2, "Related"), (9, "Related"), (2, "Unheard")}
    assert E.iter_edges(edges, node, E.EdgeFilter()).count() == 0
    import pytest

    with pytest.raises(LookupError):
        E.iter_edges(edges, node, E.EdgeFilter(), strict=True)


def test_long_chain_and_ties(spark, golden):
    """A path through repeated equal edges is found once per predicate, in the order of the steps."""
    relation = spark.createDataFrame([(1, 2, p, FIRST, LAST, None) for p in ("Is a", "Subsumes", "Is a")] + [(2, 3, "Is a", FIRST, LAST, None)], RELATION)
    tables = VocabularyTables(golden.concept, VocabularyTables.from_frames(golden.concept, relation, golden.relationship, golden.concept_ancestor, golden.concept_synonym).concept_relationship, golden.relationship, golden.concept_ancestor, golden.concept_synonym)
    pairs = spark.createDataFrame([("p", 1, 3), ("p", 1, 3)], "pair_id string, source long, target long")
    found = shortest_paths(E.enriched_edges(tables), pairs).paths.orderBy("path_no").collect()
    assert [[s.predicate for s in r.steps] for r in found] == [["Is a", "Is a"], ["Subsumes", "Is a"]]
