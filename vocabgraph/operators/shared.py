"""All shortest paths between many pairs of nodes whose searches are shared: one search per node, however many pairs it ends."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .edges import EdgeFilter
from .paths import BACK, OUT, STEP, shortest_paths

LEVELS = 3
MAX_REACH = 100_000
IDS = "array<bigint>"


@dataclass(frozen=True)
class SharedPaths:
    """summary: (pair_id, hops, reason); paths(): (pair_id, path_no, hops, steps), written; both as ``shortest_paths`` has them. turns():
    (pair_id, turn), written: how many steps its search from the source makes until the searches of a pair with a path meet."""

    summary: DataFrame
    paths: Callable[[], DataFrame]
    turns: Callable[[], DataFrame]


def shared_shortest_paths(edges: DataFrame, pairs: DataFrame, *, rule: EdgeFilter | None = None, max_depth: int = 6, max_paths: int = 20) -> SharedPaths:
    """The paths and lengths of ``shortest_paths`` without its expansions, for pairs that share their ends.

    Every source has its nodes at one, two and three steps in an array each, every target those before it. A pair is settled by looking its
    target up there, or by the nodes that are three steps from its source and nearest to its target. A path is then a leg
    of up to three steps, or two that meet in such a node; legs are made once for all pairs. Where more than ``MAX_REACH`` walks of three
    steps begin or end at one node (hubs), or paths may be longer than two legs, each pair searches on its own as before.
    """
    scratch = Scratch(edges.sparkSession, "shared")
    links = edges.where((rule or EdgeFilter()).condition()).select(F.col("subject_id").alias("s"), F.col("predicate_id").alias("p"), F.col("object_id").alias("o")).dropna().distinct()
    every = scratch.cut(links, "links")
    links = every.where("s <> o")
    out = links.select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()
    back = out.select(F.col("b").alias("a"), F.col("a").alias("b"))
    if max_depth > 2 * LEVELS or max(_most_walks(out), _most_walks(back)) > MAX_REACH:
        found = shortest_paths(edges, pairs, rule=rule, max_depth=max_depth, max_paths=max_paths)
        opened = found.expansions.where(F.col("side") == OUT).groupBy("pair_id").agg((F.max("depth") + 1).alias("turn"))
        opened = found.summary.where("hops > 0").select("pair_id").join(opened, "pair_id", "left").select("pair_id", F.coalesce("turn", F.lit(0)).alias("turn"))
        return SharedPaths(found.summary, lambda: scratch.cut(found.paths, "paths"), lambda: scratch.cut(opened, "turns"))
    asked = scratch.cut(pairs.select("pair_id", "source", "target").dropna().dropDuplicates(["pair_id"]), "pairs")
    known = scratch.cut(_lengths(asked.where("source <> target").select(F.col("source").alias("s"), F.col("target").alias("t")).distinct(), out, back, scratch).where(F.col("n") <= max_depth), "known")
    same = F.col("source") == F.col("target")
    lengths = known.select(F.col("s").alias("source"), F.col("t").alias("target"), "n")
    hops = F.when(same, 0).otherwise(F.col("n"))
    reason = F.when(same, "source_equals_target").when(hops.isNull(), "no_path").otherwise("shortest_paths_found")
    summary = asked.join(lengths, ["source", "target"], "left").select("pair_id", hops.alias("hops"), reason.alias("reason"))

    def paths() -> DataFrame:
        ways = _ways(known, links, max_paths, scratch)
        every = asked.join(ways, ["source", "target"]).select("pair_id", "hops", F.posexplode("ways").alias("no", "steps"))
        every = every.select("pair_id", (F.col("no") + 1).alias("path_no"), "hops", "steps")
        still = asked.where(same).select("pair_id", F.lit(1).alias("path_no"), F.lit(0).alias("hops"), F.array().cast(f"array<{STEP}>").alias("steps"))
        return scratch.cut(every.unionByName(still), "paths")

    def turns() -> DataFrame:
        found = _turns(known.select("s", "t", "n"), every.select("s", "o").distinct(), scratch).toDF("source", "target", "turn")
        return scratch.cut(asked.join(found, ["source", "target"]).select("pair_id", "turn"), "turns")

    return SharedPaths(summary, paths, turns)


def _most_walks(hops: DataFrame) -> int:
    """The greatest number of walks of up to LEVELS steps that begin at one node of ``hops`` (a, b)."""
    walks = hops.groupBy("a").agg(F.count(F.lit(1)).cast("double").alias("n"))
    for _ in range(LEVELS - 1):
        walks = hops.join(walks.select(F.col("a").alias("b"), "n"), "b", "left").groupBy("a").agg(F.sum(1 + F.coalesce("n", F.lit(0.0))).alias("n"))
    return walks.agg(F.coalesce(F.max("n"), F.lit(0.0))).first()[0]


def _spheres(hops: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, n1, n2, n3) of ``nodes`` (a) that have links: those first met at one, two and three steps along ``hops`` (a, b)."""
    own = hops.join(nodes, "a", "left_semi")
    near = nodes.unionByName(own.select(F.col("b").alias("a"))).distinct()
    one = scratch.cut(hops.groupBy("a").agg(F.collect_list("b").alias("n1")), "one")
    met = F.coalesce(F.array_distinct(F.flatten("met")), F.array().cast(IDS))
    step = lambda of, levels, c: of.join(levels.select(F.col("a").alias("b"), F.col(c).alias("m")), "b").groupBy("a").agg(F.collect_list("m").alias("met"))
    two = one.join(near, "a", "left_semi").join(step(hops.join(near, "a", "left_semi"), one, "n1"), "a", "left")
    two = scratch.cut(two.select("a", "n1", F.array_except(F.array_except(met, "n1"), F.array("a")).alias("n2")), "two")
    three = two.join(nodes, "a", "left_semi").join(step(own, two, "n2"), "a", "left")
    return three.select("a", "n1", "n2", F.array_except(F.array_except(F.array_except(met, "n1"), F.col("n2")), F.array("a")).alias("n3"))


def _lengths(pairs: DataFrame, out: DataFrame, back: DataFrame, scratch: Scratch) -> DataFrame:
    """(s, t, n, mids) of the ``pairs`` (s, t) with a path of n steps: beyond three, mids are the nodes of a shortest path three steps from s."""
    none = F.array().cast(IDS)
    pairs = scratch.cut(pairs.join(out.select(F.col("a").alias("s"), F.col("b").alias("t"), F.lit(1).alias("n")), ["s", "t"], "left"), "asked")
    left = pairs.where("n IS NULL").select("s", "t")
    ahead = _spheres(out, left.select(F.col("s").alias("a")).distinct(), scratch).withColumnRenamed("a", "s")
    length = F.when(F.array_contains("n2", F.col("t")), 2).when(F.array_contains("n3", F.col("t")), 3)
    left = scratch.cut(left.join(ahead, "s").withColumn("n", length).where("n IS NOT NULL OR size(n3) > 0").select("s", "t", "n", F.when(F.col("n").isNull(), F.col("n3")).alias("mids")), "left")
    far = left.where("n IS NULL").select("s", "t", "mids")
    behind = _spheres(back, far.select(F.col("t").alias("a")).distinct(), scratch)
    behind = behind.select(F.col("a").alias("t"), F.posexplode(F.array("n1", "n2", "n3")).alias("k", "nodes")).select("t", F.explode("nodes").alias("mid"), (F.col("k") + 1).alias("k"))
    # by target and node, so that neither a target of many pairs nor its many nodes meet in one task
    far = far.select("s", "t", F.explode("mids").alias("mid")).join(behind, ["t", "mid"]).groupBy("s", "t").agg(F.min("k").alias("k"), F.collect_list(F.struct("k", "mid")).alias("met"))
    far = far.select("s", "t", (F.col("k") + LEVELS).alias("n"), F.transform(F.filter("met", lambda m: m["k"] == F.col("k")), lambda m: m["mid"]).alias("mids"))
    settled = pairs.where("n IS NOT NULL").select("s", "t", "n", none.alias("mids")).unionByName(left.where("n IS NOT NULL").select("s", "t", "n", none.alias("mids")))
    return settled.unionByName(far)


def _turns(known: DataFrame, hops: DataFrame, scratch: Scratch) -> DataFrame:
    """(s, t, turn) of the pairs ``known`` (s, t, n): the steps that ``shortest_paths`` makes from s, its rule followed along ``hops`` (s, o).

    In a round every pair needs how many links leave the nodes at one depth of either search; that is worked out once for each node and depth
    some pair comes to.
    """
    ways = hops.select(F.lit(OUT).alias("side"), F.col("s").alias("node"), F.col("o").alias("next")).unionByName(hops.select(F.lit(BACK).alias("side"), F.col("o").alias("node"), F.col("s").alias("next")))
    ways = scratch.cut(ways, "ways")
    fan = scratch.cut(ways.groupBy("side", "node").agg(F.count(F.lit(1)).alias("fan")), "fan")
    state = known.select("s", "t", "n", F.lit(0).alias("ahead"), F.lit(0).alias("behind"))
    key = ["side", "origin", "depth"]
    total, left, done = 0, 1, []
    while left:
        total += 1
        end = lambda side, origin, depth: F.struct(F.lit(side).alias("side"), F.col(origin).alias("origin"), F.col(depth).alias("depth"))
        need = state.select(F.explode(F.array(end(OUT, "s", "ahead"), end(BACK, "t", "behind"))).alias("x")).select("x.*").distinct()
        if total == 1:
            spheres = new = scratch.cut(need.withColumn("node", F.col("origin")), "sphere")
        else:
            # a pair comes to a depth by the one before, so all nearer nodes of an origin are known
            near = spheres.select("side", "origin", (F.col("depth") + 1).alias("depth"), "node")
            new = need.join(weights, key, "left_anti").join(near, key).join(ways, ["side", "node"]).select(*key, F.col("next").alias("node")).distinct()
            new = scratch.cut(new.join(spheres, ["side", "origin", "node"], "left_anti").select(*key, "node"), "sphere")
            spheres = spheres.unionByName(new)
        weight = scratch.cut(new.join(fan, ["side", "node"], "left").groupBy(*key).agg(F.coalesce(F.sum("fan"), F.lit(0)).alias("w")), "weights")
        weights = weight if total == 1 else weights.unionByName(weight)
        side = lambda side, *names: weights.where(F.col("side") == side).select("origin", "depth", "w").toDF(*names)
        both = state.join(side(OUT, "s", "ahead", "_out"), ["s", "ahead"]).join(side(BACK, "t", "behind", "_back"), ["t", "behind"])
        moves = F.col("_out") <= F.col("_back")
        moved = both.select("s", "t", "n", (F.col("ahead") + moves.cast("int")).alias("ahead"), (F.col("behind") + (~moves).cast("int")).alias("behind"))
        moved, seen = scratch.measured(moved, f"moved-{total}", left=F.coalesce(F.sum((F.col("n") > total).cast("int")), F.lit(0)))
        done.append(moved.where(F.col("n") == total).select("s", "t", F.col("ahead").alias("turn")))
        state, left = moved.where(F.col("n") > total), seen["left"]
    return reduce(DataFrame.unionByName, done)


def _ways(known: DataFrame, links: DataFrame, max_paths: int, scratch: Scratch) -> DataFrame:
    """(source, target, hops, ways) of the pairs ``known``: the first ``max_paths`` paths by the order of their steps."""
    far = known.where(F.col("n") > LEVELS).select("s", "t", "n", F.explode("mids").alias("mid"))
    legs = known.where(F.col("n") <= LEVELS).select(F.col("s").alias("x"), F.col("t").alias("y"), "n")
    legs = legs.unionByName(far.select(F.col("s").alias("x"), F.col("mid").alias("y"), F.lit(LEVELS).alias("n"))).unionByName(far.select(F.col("mid").alias("x"), F.col("t").alias("y"), (F.col("n") - LEVELS).alias("n")))
    legs = scratch.cut(legs.distinct(), "legs")
    step = lambda s, p, o: F.array(F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object")))
    first = links.select(F.col("s").alias("x"), F.col("p").alias("p0"), F.col("o").alias("u"))
    one = legs.where("n = 1").join(first.withColumnRenamed("u", "y"), ["x", "y"]).select("x", "y", step(F.col("x"), F.col("p0"), F.col("y")).alias("steps"))
    three = legs.where("n = 3").join(first, "x").select("x", "y", "p0", "u")
    # the last two steps of the legs, once for all that share them
    ends = legs.where("n = 2").select(F.col("x").alias("u"), "y").unionByName(three.select("u", "y")).distinct()
    then = links.select(F.col("s").alias("u"), F.col("p").alias("p1"), F.col("o").alias("w"))
    last = links.select(F.col("s").alias("w"), F.col("p").alias("p2"), F.col("o").alias("y"))
    ends = ends.join(then, "u").join(last, ["w", "y"]).select("u", "y", F.concat(step(F.col("u"), F.col("p1"), F.col("w")), step(F.col("w"), F.col("p2"), F.col("y"))).alias("steps"))
    ends = scratch.cut(ends, "ends")
    two = legs.where("n = 2").join(ends.withColumnRenamed("u", "x"), ["x", "y"]).select("x", "y", "steps")
    three = three.join(ends, ["u", "y"]).select("x", "y", F.concat(step(F.col("x"), F.col("p0"), F.col("u")), "steps").alias("steps"))
    rest = two.unionByName(three)
    cap = lambda ways: F.slice(ways, 1, max_paths)
    leg = scratch.cut(one.unionByName(rest).groupBy("x", "y").agg(cap(F.array_sort(F.collect_list("steps"))).alias("ways")), "ways")
    close = known.where(F.col("n") <= LEVELS).join(leg.toDF("s", "t", "ways"), ["s", "t"]).select("s", "t", "n", "ways")
    # beginnings are of one length and sorted, so all combinations of a meeting come sorted
    both = far.join(leg.toDF("s", "mid", "begin"), ["s", "mid"]).join(leg.toDF("mid", "t", "end"), ["mid", "t"])
    both = both.select("s", "t", "n", cap(F.flatten(F.transform("begin", lambda a: F.transform("end", lambda b: F.concat(a, b))))).alias("ways"))
    both = both.groupBy("s", "t", "n").agg(cap(F.array_sort(F.flatten(F.collect_list("ways")))).alias("ways"))
    return close.unionByName(both).select(F.col("s").alias("source"), F.col("t").alias("target"), F.col("n").alias("hops"), "ways")
