"""Grounding: paths to few targets against the pairs' own searches, and plans that stay small for the driver."""

import random
import re
from datetime import date

import pytest

from vocabgraph.operators.edges import EdgeFilter
from vocabgraph.operators.paths import paths_to_targets, shortest_paths
from vocabgraph.plans import graph_queries as G
from vocabgraph.scratch import Scratch

EDGE = "subject_id long, predicate_id string, object_id long, kind string, valid_start_date date, valid_end_date date, invalid_reason string, subject_domain string, object_domain string, dangling boolean"
RULE = EdgeFilter(within_domain=False)


@pytest.fixture
def joins(monkeypatch):
    """The joins of every plan that is written."""
    seen, cut = [], Scratch.cut

    def counted(self, df, name, partition_by=None):
        seen.append(len(re.findall(r"\bJoin \w+", df._jdf.queryExecution().optimizedPlan().toString())))
        return cut(self, df, name, partition_by)

    monkeypatch.setattr(Scratch, "cut", counted)
    return seen


def test_walks_to_targets_are_written_step_by_step(spark, joins):
    rng = random.Random(3)
    links = {(rng.randrange(30), p, rng.randrange(30)) for p in "ab" for _ in range(30)} | {(n, p, n + 1) for n in range(100, 107) for p in "ab"}
    edges = spark.createDataFrame([(s, p, o, "x", date(1990, 1, 1), date(2099, 12, 31), None, "d", "d", False) for s, p, o in links], EDGE)
    sources, targets = [*range(30), *range(100, 108)], [0, 1, 104, 107]
    found = paths_to_targets(edges, spark.createDataFrame([(s,) for s in sources], "source long"), spark.createDataFrame([(t,) for t in targets], "target long"), rule=RULE, max_paths=3)
    got = sorted((r.source, r.target, r.path_no, r.hops, tuple(map(tuple, r.steps))) for r in found.collect())
    assert joins and max(joins) <= 2
    pairs = spark.createDataFrame([(s, t) for s in sources for t in targets], "source long, target long").selectExpr("struct(source, target) AS pair_id", "source", "target")
    own = shortest_paths(edges, pairs, rule=RULE, max_paths=3).paths.collect()
    assert got == sorted((*r.pair_id, r.path_no, r.hops, tuple(map(tuple, r.steps))) for r in own) and max(r[3] for r in got) == 6


def test_grounding_brings_concepts_to_one_row_once(spark, sf, joins):
    df = G.ground_terms(spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "loaded_at" not in plan and df.count() > 0
    assert max(joins) <= 9


def test_index_of_grams_is_not_broadcast(spark, sf):
    df = G.L.label_lookup(G._tables(spark, sf), G._first_words(spark, sf), fuzzy=True)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"SortMergeJoin \[gram#\d+\], \[gram#\d+\], Inner", plan) and not re.search(r"BroadcastHashJoin \[gram#\d+\], \[gram#\d+\], Inner", plan)
