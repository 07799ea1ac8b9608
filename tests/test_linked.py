"""Pairs with a link settled by a join, hubs walked by asking for links, against a search by brute force."""

import random
from datetime import date

import pytest

from vocabgraph.operators import paths
from vocabgraph.operators.edges import EdgeFilter

EDGE = "subject_id long, predicate_id string, object_id long, kind string, valid_start_date date, valid_end_date date, invalid_reason string, subject_domain string, object_domain string, dangling boolean"
RULE = EdgeFilter(within_domain=False)


def brute(links, source, target, most):
    walks = [()] if source == target else []
    front = [((), source)]
    for _ in range(6):
        if walks:
            break
        front = [((*w, (s, p, o)), o) for w, at in front for s, p, o in links if s == at]
        walks = [w for w, at in front if at == target]
    return sorted(walks)[:most]


@pytest.mark.parametrize("hub", [1000, 2])
def test_linked_pairs_are_not_searched(spark, monkeypatch, hub):
    rng = random.Random(8)
    links = {(rng.randrange(1, 25), p, rng.randrange(1, 25)) for p in "abc" for _ in range(9)} | {(0, "a", n) for n in range(1, 12)} | {(n, "b", 0) for n in range(8, 20)} | {(n, p, n + 1) for n in range(100, 107) for p in "ab"}
    edges = spark.createDataFrame([(s, p, o, "x", date(1990, 1, 1), date(2099, 12, 31), None, "d", "d", False) for s, p, o in links], EDGE)
    ends = sorted({(s, o) for s, _, o in links} | {(rng.randrange(25), rng.randrange(25)) for _ in range(60)} | {(100, 100 + n) for n in range(8)} | {(5, 5), (999, 1)})
    pairs = spark.createDataFrame([(f"{s}>{t}", s, t) for s, t in ends], "pair_id string, source long, target long")
    searched, search = [], paths.shortest_paths

    def watched(edges, rest, **k):
        searched.extend((r.source, r.target) for r in rest.collect())
        return search(edges, rest, **k)

    monkeypatch.setattr(paths, "shortest_paths", watched)
    monkeypatch.setattr(paths, "HUB", hub, raising=False)
    got = sorted((r.pair_id, r.path_no, r.hops, tuple(map(tuple, r.steps))) for r in paths.linked_shortest_paths(edges, pairs, rule=RULE, max_paths=4).collect())
    want = sorted((f"{s}>{t}", n + 1, len(w), w) for s, t in ends for n, w in enumerate(brute(links, s, t, 4)))
    assert got == want and max(r[2] for r in want) == 6
    linked = {(s, o) for s, _, o in links if s != o}
    assert searched and not linked & set(searched)
