import pytest

from vocabgraph.api import EdgeFilter, ExactLabelResolver, ExactSynonymResolver, GroundingConstraints, KnowledgeGraph, PartialLabelResolver, ResolverConfidence, ResolverPipeline, ground_terms
from vocabgraph.operators import edges as E
from vocabgraph.operators import hierarchy as H
from vocabgraph.operators import labels as L
from vocabgraph.operators import lookup as K
from vocabgraph.operators import phenotype as P
from vocabgraph.render import render_explained_path, render_path, render_subgraph, render_trace


@pytest.fixture(scope="module")
def graph(golden):
    return KnowledgeGraph(golden).persist()


def ids(paths):
    return [[s.subject for s in p.steps] + [p.steps[-1].object] for p in paths]


def test_shortest_paths(graph):
    onto = ["ONTOLOGICAL"]
    assert ids(graph.find_shortest_paths(4, 1, predicate_kinds=onto)[0]) == [[4, 2, 1], [4, 3, 1]]
    assert ids(graph.find_shortest_paths(6, 1, predicate_kinds=["ONTOLOGICAL", "MAPPING"])[0]) == [[6, 4, 2, 1], [6, 4, 3, 1]]
    assert ids(graph.find_shortest_paths(4, 5, predicate_kinds=onto)[0]) == [[4, 3, 5]]
    assert ids(graph.find_shortest_paths(4, 1, predicate_kinds=onto, max_paths=1)[0]) == [[4, 2, 1]]
    assert graph.find_shortest_paths(4, 1, predicate_kinds=onto, max_depth=1)[0] == []
    assert graph.find_shortest_paths(9, 1, traced=True)[1].terminated_reason == "no_path"
    assert graph.find_shortest_paths(8, 4)[0] == []  # another domain
    paths, trace = graph.find_shortest_paths(4, 4, traced=True)
    assert [p.steps for p in paths] == [()] and trace.terminated_reason == "source_equals_target" and paths[0].nodes() == ()


def test_ranked_and_explained(graph):
    found = graph.find_ranked_paths_with_explanations(6, 1, predicate_kinds=["ONTOLOGICAL", "MAPPING"])
    assert [x.profile.path_rank() for x in found] == [(0, 1, 0, 1, 1, 3, -2)] * 2
    assert [(s.traversal_depth, s.kind) for s in found[0].steps] == [(0, "MAPPING"), (1, "ONTOLOGICAL"), (None, "ONTOLOGICAL")]
    assert graph.find_ranked_paths_with_explanations(9, 1) == []
    path = found[0].path
    assert graph.path_profile(path) == found[0].profile
    assert graph.rank_paths([path])[0][1] == found[0].profile


def test_traverse(graph):
    sub, trace = graph.traverse([4, 4], predicate_kinds=["ONTOLOGICAL"], max_depth=2)
    assert sub.nodes == {1, 2, 3, 4, 5} and len(sub.edges) == 7 and trace.seeds == (4,)
    assert [(s.depth, s.node) for s in trace.steps] == [(0, 4), (1, 2), (1, 3)] and trace.terminated_reason is None
    smaller, _ = graph.traverse([4], predicate_kinds=["ONTOLOGICAL"], max_depth=1)
    assert smaller.nodes < sub.nodes
    capped, trace = graph.traverse([4], predicate_kinds=["ONTOLOGICAL"], max_depth=2, max_nodes=2)
    assert capped.nodes == {4, 2} and trace.terminated_reason == "max_nodes" and [s.node for s in trace.steps] == [4]
    unknown, _ = graph.traverse([12345], max_depth=2)
    assert unknown.nodes == {12345} and unknown.edges == ()


def test_edges(graph):
    assert [(e.predicate_id, e.object_id) for e in graph.iter_edges(4)] == [("Is a", 2), ("Is a", 3), ("Mapped from", 6), ("Maps to", 4)]
    assert ("Has site", 8) in [(e.predicate_id, e.object_id) for e in graph.iter_edges(4, within_domain=False)]
    assert [e.subject_id for e in graph.iter_edges(3, direction="in", predicate="Is a")] == [4, 5]
    assert [e.subject_id for e in graph.iter_edges(3, direction="in", predicate="Is a", active_only=False)] == [4, 5, 7]
    assert graph.outgoing_edges(7, "Is a")[0].invalid_reason == "D" and len(graph.incoming_edges(8)) == 1
    assert graph.predicate_kind("Maps to") == "MAPPING" and graph.predicate_kind("Has site") == "ATTRIBUTE" and graph.predicate_kind("Related") == "METADATA" and graph.predicate_kind("Replaced by") == "VERSIONING"
    assert graph.reverse_predicate_id("Is a") == "Subsumes" and graph.predicate_name("Maps to") == "Maps to standard"
    with pytest.raises(TypeError):
        E.predicate_key(3)
    assert E.predicate_key(graph.predicate("Is a")) == "Is a"


def test_active_on_date(graph):
    from datetime import date

    assert graph.iter_edges(4, predicate="Is a", on=date(1980, 1, 1)) == () and len(graph.iter_edges(4, predicate="Is a", on=date(1990, 1, 1))) == 2


def test_lookups(graph, golden):
    assert graph.concept_view(6).vocabulary_id == "V2" and graph.concept_id_by_code("V1", "k3") == 3
    with pytest.raises(K.NotExactlyOne):
        graph.concept_view(77)
    with pytest.raises(K.NotExactlyOne):
        graph.concept_id_by_code("V1", "K3")
    with pytest.raises(K.NotExactlyOne):
        graph.predicate("No such")
    assert graph.synonyms_for_concept(4) == ("100% c", "syn four") and graph.synonyms_for_concept(99) == ()
    assert graph.parents(4) == (2, 3)
    assert sorted(r[0] for r in H.roots(golden).collect()) == [1, 8, 9]
    assert sorted(r[0] for r in H.leaves(golden).collect()) == [4, 5, 8, 9]
    assert sorted(r[0] for r in H.singletons(golden).collect()) == [8, 9] and [r[0] for r in H.singletons(golden, domain_id="Site").collect()] == [8]
    graph.rollback_session()


def test_labels(graph, spark, golden):
    assert [m.concept_id for m in graph.label_lookup("  C4 ")] == [4] and graph.label_lookup("   ") == ()
    assert [m.concept_id for m in graph.label_lookup("c", fuzzy=True)][:2] == [1, 2]
    assert graph.label_lookup("c", fuzzy=True)[-1].concept_id == 7  # neither standard nor active
    assert [m.match_kind for m in graph.synonym_lookup("SYN FOUR")] == ["SYNONYM"]
    assert graph.concept_ids_by_label("C4") == (4,) and graph.concept_ids_by_label(" c4") == ()
    terms = spark.createDataFrame([(1, "0% c"), (2, "%"), (3, "s_n f"), (4, "zz"), (5, None)], "term_id long, text string")
    wild = {(r.term_id, r.matched_label) for r in L.synonym_lookup(golden, terms, fuzzy=True).collect()}
    assert wild == {(1, "100% c"), (2, "100% c"), (2, "syn four"), (3, "syn four")}
    plain = {(r.term_id, r.matched_label) for r in L.synonym_lookup(golden, terms, fuzzy=True, escape=True).collect()}
    assert plain == {(1, "100% c"), (2, "100% c")}


def test_resolving_and_grounding(graph, spark, golden):
    terms = spark.createDataFrame([(1, "C4"), (2, "syn four"), (3, "c"), (4, "")], "term_id long, text string")
    pipeline = ResolverPipeline([ExactLabelResolver(), ExactSynonymResolver(), PartialLabelResolver()], ResolverConfidence.EXACT)
    hits = {(r.term_id, r.concept_id, r.resolver, r.hit_no) for r in pipeline.resolve(golden, terms).collect()}
    assert {h for h in hits if h[0] < 3} == {(1, 4, "exact_label", 1), (2, 4, "exact_synonym", 1)} and len([h for h in hits if h[0] == 3]) == 9
    whole = ResolverPipeline([ExactLabelResolver(), PartialLabelResolver()]).resolve(golden, terms.where("term_id = 1"))
    assert [(r.concept_id, r.resolver) for r in whole.collect()] == [(4, "exact_label")]
    partial_after = ResolverPipeline([ExactLabelResolver(), PartialLabelResolver()], ResolverConfidence.PARTIAL).resolve(golden, terms.where("term_id = 3"))
    assert partial_after.count() == 9
    found = ground_terms(golden, graph.edges, terms, pipeline, GroundingConstraints((1, 5), frozenset(["Thing"]))).orderBy("term_id", "rank_no").collect()
    assert [(r.concept_id, len(r.paths)) for r in found if r.term_id == 1] == [(4, 3)]
    assert [r.concept_id for r in found if r.term_id == 3] == [1, 5, 2, 3, 4]
    strict = ground_terms(golden, graph.edges, terms, pipeline, GroundingConstraints((5,), upward_only=True)).collect()
    assert [(r.term_id, r.concept_id, r.hops) for r in strict] == [(3, 5, 0)]
    assert ground_terms(golden, graph.edges, terms, pipeline, GroundingConstraints(())).count() == 0


def test_phenotypes(graph, spark):
    closure = lambda n: sorted(r.node for r in P.subsumes_closure(graph.edges, spark.createDataFrame([(0, n)], "group_id long, root long")).collect())
    assert [closure(n) for n in (1, 3, 2)] == [[2, 3, 4, 5], [4, 5], [4]]
    seeds = spark.createDataFrame([(0, 4), (0, 5), (0, 5)], "group_id long, concept_id long")
    found = P.common_parents(graph.edges, seeds)
    stats = {r.parent_id: r for r in found.stats.collect()}
    assert set(stats) == {1, 3}
    assert (stats[3].coverage, stats[3].pollution, stats[3].purity, stats[3].completeness, stats[3].max_depth) == (2, 0, 1.0, 1.0, 1)
    assert (stats[1].coverage, stats[1].pollution, stats[1].purity, stats[1].completeness, stats[1].max_depth) == (2, 2, 0.5, 1.0, 2)
    picks = P.greedy_cover(seeds, found).collect()
    assert [(p.parent_id, p.gain, round(p.score, 6)) for p in picks] == [(3, 2, 1.231144)]
    assert {(r.from_id, r.to_id, r.overlap) for r in P.relate_groups(found).collect()} == {(3, 1, 2), (1, 3, 2)}
    ones = spark.createDataFrame([(6,), (4,), (5,)], "concept_id long")
    assert {tuple(r) for r in P.standardise_ids(graph.edges, ones).collect()} == {(6, 4), (4, 4), (5, 5)}
    assert P.common_parents(graph.edges, seeds, max_up_depth=0).stats.count() == 0


def test_rendering(graph):
    path = graph.find_shortest_paths(4, 1, predicate_kinds=["ONTOLOGICAL"])[0][0]
    assert render_path(graph, path, format="text") == "c4 --[Is a]--> c2\nc2 --[Is a]--> c1"
    mermaid = render_path(graph, path, format="mmd")
    assert mermaid.startswith("graph LR") and "-->|Is a|" in mermaid
    assert "<b>--[Is a]--></b>" in render_path(graph, path, format="html")
    sub, trace = graph.traverse([4], predicate_kinds=["ONTOLOGICAL"], max_depth=2)
    assert render_subgraph(graph, sub, format="text").splitlines()[:3] == ["Subgraph:", "  Nodes: 5", "  Edges: 7"]
    assert render_subgraph(graph, sub, format="mmd").startswith("graph TD") and "Nodes: 5" in render_subgraph(graph, sub, format="html")
    assert render_trace(graph, trace, format="mmd") == render_trace(graph, trace, format="text") and "[depth 0]" in render_trace(graph, trace, format="html")
    told = graph.find_ranked_paths_with_explanations(4, 1, predicate_kinds=["ONTOLOGICAL"])[0]
    assert "(ONTOLOGICAL)" in render_explained_path(graph, told, format="text") and "<table>" in render_explained_path(graph, told, format="html")


def test_edge_filter_defaults():
    assert EdgeFilter() == EdgeFilter(None, None, True, None, True) and E.kinds_tuple([]) is None


def test_single_results(graph):
    import vocabgraph

    assert vocabgraph.KnowledgeGraph is KnowledgeGraph and vocabgraph.PredicateKind.MAPPING.label().startswith("mapping")
    assert ids(graph.find_shortest_paths(4, 1, predicate_kinds=[vocabgraph.PredicateKind.ONTOLOGICAL])[0]) == [[4, 2, 1], [4, 3, 1]]
    pipeline = ResolverPipeline([ExactLabelResolver(), ExactSynonymResolver()])
    assert [(h.concept_id, h.resolver) for h in graph.resolve("syn four", pipeline)] == [(4, "exact_synonym")]
    found = graph.ground_term("c4", constraints=GroundingConstraints((1,)), resolver_pipeline=pipeline)
    assert [(c.concept_id, c.best_path_profile.hops, len(c.paths)) for c in found] == [(4, 2, 2)]
    assert graph.standardise_ids([6, 5]) == {6: 4, 5: 5} and graph.parent_search(4) == {2, 3} and graph.descendants(1, [3]) == {2, 3, 4}
    parents = graph.find_common_parents([4, 5])
    assert parents[3].found == {4, 5} and parents[1].descendants == {2, 3, 4, 5}
    assert graph.greedy_parent_cover([4, 5], parents) == [3] and graph.relate_groups(parents)[0] == {"type": "subsumed_by", "from": 1, "to": 3, "overlap": 2}
