"""Orphans, hierarchies and heavy keys against brute force, with hostile inputs."""

import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vocabgraph.operators.forest import all_descendants, closure_findings, hierarchy
from vocabgraph.operators.orphans import Reference, orphan_references, orphan_report
from vocabgraph.operators.skew import eager_join_aggregate, heavy_join_keys, joined_states, key_profile, row_counts


def at(day, hour=0, month=1):
    return datetime(2022, month, day, hour)


@pytest.mark.parametrize("encode", ["identity", "dictionary"])
def test_orphans(spark, encode):
    rng = random.Random(3)
    ids = [-5, 0, 7, 40_000, 70_000, 10**12]
    parents = [(rng.choice(ids), at(rng.randrange(1, 28), rng.randrange(24), rng.randrange(1, 4)), rng.choice([None, "D", "U"]), "x") for _ in range(14)] + [(None, at(1), None, "x"), (99, None, None, "x")]
    refs = [(rng.choice([*ids, 99, 123, None]), rng.choice([at(rng.randrange(1, 28), rng.randrange(24), rng.randrange(1, 4)), None])) for _ in range(300)]
    parent = spark.createDataFrame(parents, "id long, loaded_at timestamp, invalid_reason string, period string")
    ref = spark.createDataFrame(refs * 2, "id long, loaded_at timestamp").withColumn("key", F.lit("clash"))
    got = {tuple(r) for r in orphan_references([Reference(ref, "t", "id")], parent, "id", encode=encode).collect()}
    want = set()
    for key, when in refs:
        if key is None:
            continue
        own = [p for p in parents if p[0] == key]
        reason = None
        if not own:
            reason = "missing"
        else:
            last = max((p[1] or datetime.min, p[2] == "D") for p in own)
            first = min((p[1] for p in own if p[1]), default=None)
            if last[1]:
                reason = "deleted"
            elif first and when and first > when:
                reason = "late"
        if reason:
            want.add(("t", "id", key, when.strftime("%Y-%m") if when else None, reason))
    assert got == want
    report = orphan_report(orphan_references([Reference(ref, "t", "id")], parent, "id", encode=encode)).collect()
    assert sum(r.n_keys for r in report) == len(want)


def test_orphans_of_a_dense_hot_range_and_many_sparse_ones(spark):
    """Words full of references beside words of one bit, all bits of a word, the sign bit among them; a hot key a thousand times."""
    parent = spark.createDataFrame([(k, at(1 + k % 3), "D" if k % 50 == 0 else None) for k in range(-64, 512) if k % 7] + [(10_000 * k, at(5), None) for k in range(3, 40, 2)], "id long, loaded_at timestamp, invalid_reason string")
    rows = [(k, at(2, 1)) for k in range(-70, 520)] + [(10_000 * k, at(4)) for k in range(3, 40)] + [(3, at(2, 3))] * 1000
    ref = spark.createDataFrame(rows, "id long, loaded_at timestamp")
    got = {(r.key, r.reason) for r in orphan_references([Reference(ref, "t", "id")], parent, "id").collect()}
    known = {k: (1 + k % 3, k % 50 == 0) for k in range(-64, 512) if k % 7} | {10_000 * k: (5, False) for k in range(3, 40, 2)}
    want = {(k, "missing" if k not in known else "deleted" if known[k][1] else "late") for k, when in rows if k not in known or known[k][1] or at(known[k][0]) > when}
    assert got == want and {"missing", "deleted", "late"} == {r for _, r in want}


def test_orphans_of_text_keys_and_empty_tables(spark):
    parent = spark.createDataFrame([("a", at(1), None)], "id string, loaded_at timestamp, invalid_reason string")
    ref = spark.createDataFrame([("a", at(2)), ("b", at(2)), ("", at(2))], "id string, loaded_at timestamp")
    assert {r.key for r in orphan_references([Reference(ref, "t", "id")], parent, "id", encode="dictionary").collect()} == {"b", ""}
    assert orphan_references([Reference(ref.limit(0), "t", "id")], parent, "id", encode="dictionary").count() == 0
    assert orphan_references([Reference(ref, "t", "id")], parent.limit(0), "id", encode="dictionary").count() == 3


def _reach(pairs, nodes):
    up = {}
    for c, p in pairs:
        up.setdefault(c, set()).add(p)
    out = {}
    for n in nodes:
        seen, frontier, k = {}, {n}, 0
        while frontier:
            k += 1
            frontier = {p for x in frontier for p in up.get(x, ()) if p not in seen}
            seen |= dict.fromkeys(frontier, k)
        out[n] = seen
    return out


@pytest.mark.parametrize("seed,back", [(1, 0), (2, 3)])
def test_hierarchy_and_findings(spark, seed, back):
    rng = random.Random(seed)
    links = [(i, rng.randrange(max(1, i - 9), i)) for i in range(2, 60) for _ in range(rng.choice([1, 1, 2]))] + [(rng.randrange(1, 30), rng.randrange(30, 60)) for _ in range(back)] + [(7, 7)] * bool(back)
    nodes = sorted({x for pair in links for x in pair})
    reach = _reach(links, nodes)
    stated = [(a, n, d) for n, own in reach.items() for a, d in own.items() if a != n]
    wrong = [(a, n, d + (n % 9 == 0)) for a, n, d in stated if not (n % 11 == 0 and d == 1)]
    frame = spark.createDataFrame(links * 2 + [(None, 3), (3, None)], "child long, parent long")
    said = spark.createDataFrame(wrong * 2 + [(5, 5, 0), (None, 8, 1)], "ancestor long, descendant long, distance int")
    got = {tuple(r) for r in closure_findings(frame, said, spark.createDataFrame([(n,) for n in nodes], "node long")).collect()}
    want = {(n, "cycle") for n in nodes if n in reach[n]}
    for n in nodes:
        if {(a, d) for a, d in reach[n].items() if a != n} != {(a, d) for a, m, d in wrong + [(None, 8, 1)] if m == n}:
            want.add((n, "level"))
    assert got == want
    below = Counter(a for n in nodes for a in reach[n] if a != n)
    rows = {r.node: r for r in hierarchy(frame).collect()}
    assert set(rows) == set(nodes)
    tops = {n for n in nodes if not [p for c, p in links if c == n]}
    for n in nodes:
        r = rows[n]
        assert r.n_descendants == below[n] and r.on_cycle == (n in reach[n])
        ways = [d for a, d in {**reach[n], **({n: 0} if n in tops else {})}.items() if a in tops]
        if r.on_cycle or not ways:
            assert r.depth is None
        else:
            assert r.depth == min(ways) == len(r.path) - 1 and r.path[-1] == n and r.root == r.path[0]
            assert all((b, a) in links for a, b in zip(r.path, r.path[1:]))


def test_hierarchy_of_nothing_and_of_loops(spark):
    none = spark.createDataFrame([], "child long, parent long")
    said = spark.createDataFrame([], "ancestor long, descendant long, distance int")
    node = spark.createDataFrame([(1,), (1,), (None,)], "node long")
    assert hierarchy(none).count() == 0 and closure_findings(none, said, node).count() == 0
    ring = spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long")
    assert {(r.node, r.on_cycle, r.depth) for r in hierarchy(ring).collect()} == {(1, True, None), (2, True, None)}
    assert {tuple(r) for r in closure_findings(ring, said, node).collect()} == {(1, "cycle"), (1, "level")}
    # a ring below a top, a chain below the ring, and a chain below a ring without a top
    mixed = spark.createDataFrame([(1, 2), (2, 1), (1, 9), (3, 1), (4, 3), (11, 12), (12, 11), (13, 12), (14, 13)], "child long, parent long")
    rows = {r.node: (r.depth, r.path, r.n_descendants, r.on_cycle) for r in hierarchy(mixed).collect()}
    assert rows[9] == (0, [9], 4, False) and rows[4] == (3, [9, 1, 3, 4], 0, False) and rows[3] == (2, [9, 1, 3], 1, False)
    assert rows[1] == rows[2] == (None, None, 3, True) and rows[14] == (None, None, 0, False) and rows[12][3]


def test_heavy_keys_and_profiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([1, 2, 3, None]), rng.choice(["a", "b", None]), 0) for _ in range(900)]
    df = spark.createDataFrame(rows, "k long, v long, w string, n_rows long")
    profile = {r.k: (r.n_rows, r.v, r.w) for r in key_profile(df, "k", {"v": "v", "w": "w"}, salts=3).collect()}
    want = {k: (sum(r[0] == k for r in rows), len({r[1] for r in rows if r[0] == k} - {None}), len({r[2] for r in rows if r[0] == k} - {None})) for k in (1, 2, 3)}
    assert profile == want
    assert {r.k: r.n_rows for r in row_counts(df, "k").collect()} == {k: v[0] for k, v in want.items()}
    share = {(r.key, r.side) for r in heavy_join_keys(df, df.where("k <> 2"), "k", "k", 0.3).collect()}
    others = [r for r in rows if r[0] not in (2, None)]
    assert share == {(k, "left") for k, v in want.items() if v[0] >= 0.3 * len(rows)} | {(k, "right") for k in (1, 3) if sum(r[0] == k for r in others) >= 0.3 * len(others)}
    states = {r.key: (r.n_left, r.n_right, r.n_pairs) for r in joined_states(df, df.where("k IS NULL OR k <> 2"), "k", "k").collect()}
    counts = Counter(r[0] for r in rows)
    assert states == {k: (n, 0 if k == 2 else n, 0 if k in (2, None) else n * n) for k, n in counts.items()}
    assert heavy_join_keys(df.limit(0), df.limit(0), "k", "k", 0.1).count() == 0 and key_profile(df.limit(0), "k", {"v": "v"}).count() == 0 and key_profile(df, "k", {}).count() == 3


def test_eager_aggregation_equals_the_join(spark):
    rng = random.Random(5)
    left = [(rng.choice("ab") if rng.random() < 0.9 else None, rng.choice([1, 1, 1, 2, None])) for _ in range(60)]
    right = [(rng.choice([1, 1, 2, 9, None]), rng.choice([1, 5, None])) for _ in range(50)]
    l, r = spark.createDataFrame(left, "g string, k long"), spark.createDataFrame(right, "k2 long, v long")
    got = {x.g: (x.n_pairs, x.total) for x in eager_join_aggregate(l, r, "k", "k2", "g", {"total": F.col("v")}).collect()}
    want = {x.g: (x.n, x.t) for x in l.join(r, F.col("k") == F.col("k2")).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("t")).collect()}
    assert got == want


def test_tall_hierarchies_take_few_rounds(spark):
    """A chain of 5,000 nodes; a ring of 1,000 below 300 tops; a comb whose spine of 120 has a leaf at each node."""
    chain = [(i, i + 1) for i in range(4999)]
    found = hierarchy(spark.createDataFrame(chain, "child long, parent long"))
    wrong = found.where("depth <> 4999 - node OR root <> 4999 OR n_descendants <> node OR on_cycle OR size(path) <> depth + 1 OR path[0] <> 4999 OR path[depth] <> node").count()
    assert wrong == 0 and found.count() == 5000
    ring = [(i, (i + 1) % 1000) for i in range(1000)] + [(7 * i % 1000, 10_000 + i) for i in range(300)]
    rows = hierarchy(spark.createDataFrame(ring, "child long, parent long")).collect()
    assert len(rows) == 1300 and all((r.on_cycle, r.n_descendants, r.depth) == ((True, 999, None) if r.node < 1000 else (False, 1000, 0)) for r in rows)
    comb = [(i, i + 1) for i in range(119)] + [(1000 + i, i) for i in range(120)]
    found = {(r.node, r.descendant): r.distance for r in all_descendants(spark.createDataFrame(comb, "child long, parent long")).collect()}
    assert found == {(i, j): i - j for i in range(120) for j in range(i)} | {(i, 1000 + j): i - j + 1 for i in range(120) for j in range(i + 1)}
