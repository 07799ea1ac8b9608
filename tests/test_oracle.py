"""Registered queries against their SQL in DuckDB, on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from vocabgraph.plans import catalog

#: one of each family; the others share its operator calls and are compared at the larger scale outside the tests
NAMES = [
    "concept_view_batch", "concept_by_code", "concept_synonyms", "predicate_row", "predicate_kind", "predicate_reverse", "edges_out", "edges_in", "edges_in_filtered", "edges_of_predicate", "standard_concepts", "leaves_vocabulary", "edges_batch", "edges_active_on_date", "edges_by_kind", "edges_same_domain", "edges_cross_domain", "parents", "children", "ancestors", "roots", "roots_domain", "leaves", "singletons",
    "label_rank", "label_wildcards", "label_wildcards_escaped", "label_fuzzy", "synonym_fuzzy", "label_ids_raw", "traverse_max_nodes", "traverse_trace", "shortest_path_length", "shortest_paths", "shortest_paths_capped", "shortest_paths_parallel", "path_rank", "path_explain", "ranked_paths", "resolve_partial_topk", "resolve_pipeline", "ground_terms", "ground_terms_upward", "ground_terms_constrained", "standardise_ids", "parent_search", "subsumes_closure",
    "common_parents", "relate_groups", "greedy_cover_first", "greedy_cover", "render_path_mermaid", "render_subgraph_text", "render_subgraph_mermaid", "render_trace_text", "p2_found", "p2_report", "p5_found", "p5_hierarchy", "p5_descendants", "p6_found", "p6_heavy_pairs", "p6_key_profile", "p6_join_rollup",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf}/{file}'")
    return con


def _value(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(_value(v) for v in r) for r in df.select(*columns).collect())
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(_value(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_registered_names(spark, sf):
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and set(NAMES) <= set(catalog.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
