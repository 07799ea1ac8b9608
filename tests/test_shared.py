"""Searches shared by all pairs against the pairs' own searches."""

import random
from datetime import date

import pytest

from vocabgraph.operators import shared
from vocabgraph.operators.edges import EdgeFilter
from vocabgraph.operators.paths import shortest_paths
from vocabgraph.operators.scoring import explain
from vocabgraph.plans import graph_queries as G

EDGE = "subject_id long, predicate_id string, object_id long, kind string, valid_start_date date, valid_end_date date, invalid_reason string, subject_domain string, object_domain string, dangling boolean"
RULE = EdgeFilter(within_domain=False)


@pytest.fixture(scope="module")
def net(spark):
    """A sparse graph of 60 nodes, some links twice by different predicates, one to itself, and two chains of seven steps; pairs up to and beyond six steps."""
    rng = random.Random(5)
    links = {(rng.randrange(60), p, rng.randrange(60)) for p in "ab" for _ in range(45)} | {(n, "a", n + 1) for n in range(100, 107)} | {(n, p, n + 1) for n in range(200, 207) for p in "ab"} | {(3, "a", 3)}
    edges = spark.createDataFrame([(s, p, o, "x", date(1990, 1, 1), date(2099, 12, 31), None, "d", "d", False) for s, p, o in links], EDGE)
    ends = {(rng.randrange(60), rng.randrange(60)) for _ in range(400)} | {(100, 100 + n) for n in range(8)} | {(200 + a, 200 + b) for a in range(8) for b in range(8)} | {(7, 7), (999, 1), (None, 4)}
    return edges, spark.createDataFrame([(f"{s}>{t}", s, t) for s, t in ends], "pair_id string, source long, target long")


def rows(df):
    return sorted((r.pair_id, r.path_no, r.hops, tuple(map(tuple, r.steps))) for r in df.collect())


@pytest.mark.parametrize(("depth", "most", "reach"), [(6, 20, 100_000), (5, 3, 100_000), (6, 20, 3)])
def test_shared_searches_find_the_same(net, monkeypatch, depth, most, reach):
    monkeypatch.setattr(shared, "MAX_REACH", reach)
    own = shortest_paths(*net, rule=RULE, max_depth=depth, max_paths=most)
    found = shared.shared_shortest_paths(*net, rule=RULE, max_depth=depth, max_paths=most)
    want = rows(own.paths)
    assert max(r[2] for r in want) == depth
    assert rows(found.paths()) == want
    assert {tuple(r) for r in found.summary.collect()} == {tuple(r) for r in own.summary.collect()}


def refuse(*_, **__):
    raise AssertionError("a search for each pair")


SHARED = ["shortest_paths", "shortest_path_length", "shortest_paths_capped", "path_profile", "path_rank", "path_explain", "render_path_mermaid", "render_path_text"]


@pytest.mark.parametrize("name", SHARED)
def test_path_queries_share_searches(spark, sf, monkeypatch, name):
    monkeypatch.setattr(G, "search", refuse)
    assert getattr(G, name)(spark, sf).columns[0] == "pair_id"


def test_explanations_without_expansions(spark, golden):
    steps = spark.createDataFrame([("4>1", 1, 2, [(4, "Is a", 2), (2, "Is a", 1)])], "pair_id string, path_no int, hops int, steps array<struct<subject:bigint,predicate:string,object:bigint>>")
    got = [(r.step_no, r.subject, r.object, r.traversal_depth, r.kind) for r in explain(golden, steps).orderBy("step_no").collect()]
    assert got == [(1, 4, 2, None, "ONTOLOGICAL"), (2, 2, 1, None, "ONTOLOGICAL")]


@pytest.mark.parametrize("reach", [100_000, 3])
def test_turns_are_those_of_the_pairs_own_searches(net, monkeypatch, reach):
    monkeypatch.setattr(shared, "MAX_REACH", reach)
    own = shortest_paths(*net, rule=RULE)
    ahead = {r.pair_id: r.n for r in own.expansions.where("side = 'forward'").groupBy("pair_id").agg({"depth": "max"}).toDF("pair_id", "n").collect()}
    want = {r.pair_id: ahead.get(r.pair_id, -1) + 1 for r in own.summary.where("hops > 0").collect()}
    got = {r.pair_id: r.turn for r in shared.shared_shortest_paths(*net, rule=RULE).turns().collect()}
    assert got == want and len(set(want.values())) > 3


def test_explained_depths_share_searches(spark, sf, monkeypatch):
    monkeypatch.setattr(G, "search", refuse)
    monkeypatch.setattr(shared, "shortest_paths", refuse)
    got = {r.traversal_depth: r.n_steps for r in G.path_explain_depth(spark, sf).collect()}
    monkeypatch.undo()
    t = G._tables(spark, sf)
    own = shortest_paths(G.E.enriched_edges(t), G._stated_pairs(t), rule=G.UPWARD, max_depth=G.PAIR_DEPTH, max_paths=G.MAX_PATHS)
    want = explain(t, own.paths, own.expansions).groupBy("traversal_depth").count().collect()
    assert got == {r[0]: r[1] for r in want}
