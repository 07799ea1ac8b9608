"""Covers whose rounds take all parents that lead, against one pick per round."""

import random

import pytest

from vocabgraph.operators.phenotype import CommonParents, greedy_cover
from vocabgraph.scratch import Scratch


def cover(spark, below):
    """Seeds and parents of ``below`` {(group, parent): seeds}."""
    found = spark.createDataFrame([(g, p, s) for (g, p), seeds in below.items() for s in seeds], "group_id string, parent_id long, origin long")
    stats = spark.createDataFrame([(g, p, len(s), p % 3, 1 / (1 + p % 3), 1.0, 1 + p % 4) for (g, p), s in below.items()], "group_id string, parent_id long, coverage long, pollution long, purity double, completeness double, max_depth int")
    return found.selectExpr("group_id", "origin AS concept_id").distinct(), CommonParents(stats, found, found)


@pytest.mark.parametrize(("ratio", "gain"), [(1.0, 1), (0.6, 2)])
def test_the_same_picks_as_one_at_a_time(spark, ratio, gain):
    rng = random.Random(3)
    seeds, parents = cover(spark, {(g, p): set(rng.sample(range(30), rng.randint(2, 6))) for g in "ab" for p in range(1, 13)})
    got, want = [greedy_cover(seeds, parents, target_ratio=ratio, min_gain=gain, max_picks=m).orderBy("group_id", "pick_no").collect() for m in (None, 99)]
    assert got == want and len(want) > 4


def test_parents_apart_are_taken_in_one_round(spark, monkeypatch):
    written, cut = [], Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df, name, *a: written.append(name) or cut(self, df, name, *a))
    seeds, parents = cover(spark, {("a", p): {2 * p, 2 * p + 1} for p in range(1, 11)})
    assert greedy_cover(seeds, parents).count() == 10
    assert len(written) < 12
