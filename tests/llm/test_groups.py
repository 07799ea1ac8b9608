import random

import pytest

from vocabgraph.llm.groups import match_groups


def groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {(find(x), x) for x in parent}


def shapes():
    rng = random.Random(5)
    parts = [
        [(i, i + 1) for i in range(30)], [(i, (i + 1) % 17) for i in range(17)], [(i, (i + 1) % 7) for i in range(7)] + [(100 + i, 100 + (i + 1) % 6) for i in range(6)] + [(3, 103)], [(0, i) for i in range(1, 60)], [(i, j) for i in range(5) for j in range(i)], [(2, 1)], [(1, 1), (None, 3), (3, None)],
        [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)], [(0, 1), (1, 9), (0, 2), (2, 9), (0, 3), (3, 9)], [(rng.randrange(200), rng.randrange(200)) for _ in range(180)], [(rng.randrange(60), rng.randrange(60)) for _ in range(200)],
    ]
    out = [(None if a is None else a + 1000 * n, None if b is None else b + 1000 * n) for n, part in enumerate(parts) for a, b in part]
    names = list(range(1000 * len(parts)))
    rng.shuffle(names)
    return [(None if a is None else names[a], None if b is None else names[b]) for a, b in out]


@pytest.mark.parametrize("rounds", [8, 1, 0])
def test_groups(spark, rounds):
    pairs = shapes()
    df = spark.createDataFrame([(*p, "x") for p in pairs + pairs[:50]], "a long, b long, v string")
    got = [tuple(r) for r in match_groups(df, "a", "b", rounds=rounds).collect()]
    assert len(got) == len(set(got)) and set(got) == groups(pairs)


def test_small_inputs(spark):
    make = lambda rows: spark.createDataFrame(rows, "a long, b long")
    assert match_groups(make([]), "a", "b").count() == 0 and match_groups(make([(1, 1), (None, 2)]), "a", "b").count() == 0
    assert {tuple(r) for r in match_groups(make([(5, 2), (2, 5)]), "a", "b").collect()} == {(2, 5), (2, 2)}
    assert {tuple(r) for r in match_groups(make([(3, 1), (1, 2), (2, 3)]), "a", "b").collect()} == {(1, 1), (1, 2), (1, 3)}
