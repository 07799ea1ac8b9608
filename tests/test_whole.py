"""Registered graph queries against brute force, without the bounds their SQL has."""

from collections import defaultdict
from datetime import date

import pytest
from conftest import ANCESTOR, CONCEPT, PREDICATE, PREDICATES, RELATION, SYNONYM

from vocabgraph.operators import edges as E
from vocabgraph.plans import graph_queries as G
from vocabgraph.sources.tables import VocabularyTables


def shortest(links, source, target, most):
    """All shortest paths of at most ``most`` steps, as tuples of (s, p, o)."""
    paths, seen = [((), source)], {source}
    for _ in range(most):
        paths = [((*steps, (node, p, o)), o) for steps, node in paths for p, o in links[node] if o not in seen]
        if found := sorted(steps for steps, node in paths if node == target):
            return found
        seen |= {node for _, node in paths}
    return []


def test_ranked_paths_of_several_steps(spark, sf):
    tables = G._tables(spark, sf)
    concepts = {r.concept_id: r for r in tables.concept.collect()}
    kinds, links = {}, defaultdict(set)
    for r in E.enriched_edges(tables).where("invalid_reason IS NULL").collect():
        if r.kind in ("ONTOLOGICAL", "MAPPING"):
            kinds[r.predicate_id] = r.kind
            links[r.subject_id].add((r.predicate_id, r.object_id))
    want = set()
    for source, target in {(r.concept_id_2, r.concept_id_1) for r in tables.concept_relationship.where("relationship_id = 'Maps to' AND concept_id_1 <> concept_id_2").collect()}:
        ranked = []
        for no, steps in enumerate(shortest(links, source, target, 6)[:20]):
            nodes = [concepts.get(n) for n in (source, *(o for _, _, o in steps))]
            used = [kinds[p] for _, p, _ in steps]
            invalid = sum(bool(n and n.invalid_reason) for n in nodes)
            switches = sum(bool(a and a.vocabulary_id) and a.vocabulary_id != (b and b.vocabulary_id) for a, b in zip(nodes, nodes[1:]))
            counters = (invalid, sum(n is not None and n.standard_concept is None for n in nodes), 0, used.count("MAPPING"), switches, len(steps), used.count("ONTOLOGICAL"))
            ranked.append(((*counters[:-1], -counters[-1]), no, counters, "; ".join(f"{s}|{p}|{o}" for s, p, o in steps)))
        want |= {(f"{source}>{target}", rank, steps, *counters) for rank, (_, _, counters, steps) in enumerate(sorted(ranked), 1)}
    assert max(w[8] for w in want) > 1
    assert {tuple(r) for r in G.ranked_paths(spark, sf).collect()} == want


#: 1 to 8 is a chain with the top at 1; other branches leave it at several heights, so that seeds lie one to eight links below
ABOVE = {n: [n - 1] for n in range(2, 9)} | {10: [8], 11: [8], 12: [7], 13: [5, 12], 14: [2], 15: [1], 16: [15], 20: [1], 21: [20], 22: [21]}
SEEDS = [n for n in ABOVE if n not in {p for ps in ABOVE.values() for p in ps}]


@pytest.fixture(scope="module")
def deep(spark):
    first, last = date(1990, 1, 1), date(2099, 12, 31)
    links = [(n, p) for n, ps in ABOVE.items() for p in ps]
    concepts = [(n, f"c{n}", f"k{n}", "V", "Thing", "leaf" if n in SEEDS else "inner", "S", first, last, None) for n in {*ABOVE, 1}]
    rows = [(a, b, "Is a", first, last, None) for a, b in links] + [(b, a, "Subsumes", first, last, None) for a, b in links]
    frames = ((concepts, CONCEPT), (rows, RELATION), (PREDICATES, PREDICATE), ([(b, a, 1) for a, b in links], ANCESTOR), ([], SYNONYM))
    return VocabularyTables.from_frames(*[spark.createDataFrame(*x) for x in frames])


def facts():
    """Per parent: the seeds below with the greatest of each one's first-met depths plus one, and what lies below and is no seed."""
    over = defaultdict(dict)
    for seed in SEEDS:
        depth, level = {seed: 0}, [seed]
        while level:
            level = list(dict.fromkeys(p for n in level for p in ABOVE.get(n, []) if p not in depth and not depth.update({p: depth[n] + 1})))
        for n, d in depth.items():
            for p in ABOVE.get(n, []):
                over[p][seed] = max(over[p].get(seed, 0), d + 1)
    below = defaultdict(set)
    for n in ABOVE:
        todo = list(ABOVE[n])
        while todo:
            p = todo.pop()
            below[p].add(n)
            todo += ABOVE.get(p, [])
    return {p: (s, below[p] - set(SEEDS)) for p, s in over.items() if len(s) > 1}


def test_common_parents_up_to_the_top(spark, deep, monkeypatch):
    monkeypatch.setattr(G, "_tables", lambda *_: deep)
    want = facts()
    assert max(max(s.values()) for s, _ in want.values()) > 4
    got = {(r.parent_id, r.coverage, r.pollution, r.purity, r.completeness, r.max_depth) for r in G.common_parents(spark, "").collect()}
    assert got == {(p, len(s), len(b), round(len(s) / (len(s) + len(b)), 6), round(len(s) / len(SEEDS), 6), max(s.values())) for p, (s, b) in want.items()}
    related = {(r.from_id, r.to_id, r.overlap) for r in G.relate_groups(spark, "").collect()}
    assert related == {(a, b, len(s)) for a, (s, _) in want.items() for b, (t, _) in want.items() if a != b and set(s) <= set(t)}


def test_greedy_cover_to_the_end(spark, deep, monkeypatch):
    monkeypatch.setattr(G, "_tables", lambda *_: deep)
    want, left, picks = facts(), set(SEEDS), []
    while True:
        scored = []
        for p, (s, b) in want.items():
            if gain := len(left & set(s)):
                scored.append((-gain * len(s) / (len(s) + len(b)) / ((1 + len(b)) ** 0.3 * (1 + max(s.values())) ** 0.7), p, gain))
        if not scored:
            break
        score, p, gain = min(scored)
        picks.append((len(picks) + 1, p, gain, round(-score, 6)))
        left -= set(want[p][0])
    assert not left and len(picks) > 2
    assert [(r.pick_no, r.parent_id, r.gain, r.score) for r in G.greedy_cover(spark, "").orderBy("pick_no").collect()] == picks
    assert [(r.parent_id, r.gain, r.score) for r in G.greedy_cover_first(spark, "").collect()] == [picks[0][1:]]
