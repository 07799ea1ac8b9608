"""Pairwise matches consolidated into groups: strip leaves, compress chains by list ranking, solve the core, restore.

Every removed vertex leaves a pointer (vertex -> the neighbour or chain end that stays in its stead). What remains after a
few rounds, vertices of degree three or more, is the core; its components come from repeated minimum stars. Labels
then flow back along the pointers in reverse order of removal. All state is in written tables of (id, id) rows; nothing is
collected, and a vertex with a third of all pairs is one row of the degree count and one pointer target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

CORE_ROUNDS = 40  # far beyond the logarithm of any vertex count; reached only if something is wrong


def undirected(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(x, y), x < y, distinct; pairs with a null end or two equal ends are dropped."""
    return pairs.where(f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL AND `{a}` <> `{b}`").select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()


def _darts(edges: DataFrame) -> DataFrame:
    """(u, v) both ways."""
    return edges.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(edges.select(F.col("y").alias("u"), F.col("x").alias("v")))


def _ends(edges: DataFrame) -> DataFrame:
    """(v, degree, low, high): low and high are the least and greatest neighbour, all there is to know of degrees one and two."""
    return _darts(edges).groupBy("u").agg(F.count(F.lit(1)).alias("degree"), F.min("v").alias("low"), F.max("v").alias("high")).withColumnRenamed("u", "v")


def _strip(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pointers, rest): vertices of degree one point to their neighbour; of two such neighbours the greater one points."""
    lonely = _ends(edges).where("degree = 1").select("v", F.col("low").alias("to"))
    marks = (
        edges.join(lonely.select(F.col("v").alias("x"), F.lit(True).alias("x_leaf")), "x", "left")
        .join(lonely.select(F.col("v").alias("y"), F.lit(True).alias("y_leaf")), "y", "left")
        .select("x", "y", F.coalesce("x_leaf", F.lit(False)).alias("x_leaf"), F.coalesce("y_leaf", F.lit(False)).alias("y_leaf"))
    )
    marks = scratch.cut(marks, "leaves")
    pointers = marks.where("y_leaf").select(F.col("y").alias("v"), F.col("x").alias("to")).unionByName(marks.where("x_leaf AND NOT y_leaf").select(F.col("x").alias("v"), F.col("y").alias("to")))
    return pointers, marks.where("NOT x_leaf AND NOT y_leaf").select("x", "y")


def _compress(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, bool]:
    """(pointers, rest, any): chains of degree-two vertices become one edge between their ends.

    List ranking by pointer jumping over darts: dart (u -> v) into a chain vertex goes on to v's other neighbour; each jump
    doubles the stretch, so a chain of n vertices takes log2(n) jumps. The least id passed is carried along: a cycle of
    nothing but chain vertices has no end and is settled by its least id, seen once the stretch goes round.
    """
    twos = scratch.cut(_ends(edges).where("degree = 2").select("v", "low", "high"), "chain-vertices")
    if twos.isEmpty():
        return twos.select("v", F.col("low").alias("to")), edges, False
    out = twos.select("v", F.explode(F.array("low", "high")).alias("w"))  # dart v -> w
    inner = twos.select(F.col("v").alias("w"), F.col("low").alias("l"), F.col("high").alias("h"))
    # (u, v): where the walk that leaves u through v stands: its last dart, whether it has ended, the least chain vertex passed
    start = out.join(inner, "w", "left").select(
        F.col("v").alias("u"), F.col("w").alias("v"), F.col("v").alias("a"), F.col("w").alias("b"), F.col("l").isNull().alias("ended"), F.when(F.col("l").isNull(), F.col("v")).otherwise(F.least("v", "w")).alias("least")
    )
    # the next dart of (a -> b), b a chain vertex: b -> its other neighbour
    nxt = out.join(inner, "w").select(F.col("v").alias("a"), F.col("w").alias("b"), F.col("w").alias("na"), F.when(F.col("l") == F.col("v"), F.col("h")).otherwise(F.col("l")).alias("nb"))
    first = start.join(nxt, ["a", "b"], "left").select("u", "v", F.when(F.col("ended"), F.col("a")).otherwise(F.col("na")).alias("a"), F.when(F.col("ended"), F.col("b")).otherwise(F.col("nb")).alias("b"), "ended", "least")
    walks = scratch.cut(first, "walks")
    open_before, least_before = None, None
    while True:
        # walk (u, v) has advanced to dart (a, b); dart (a, b) is itself the start of a known walk: join the stretches
        onward = walks.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("ended").alias("e2"), F.col("least").alias("l2"))
        joined = walks.where("NOT ended").join(onward, ["a", "b"]).select("u", "v", F.col("a2").alias("a"), F.col("b2").alias("b"), F.col("e2").alias("ended"), F.least("least", "l2").alias("least"))
        after = scratch.cut(walks.where("ended").unionByName(joined), "walks")
        open_now, least_now = after.where("NOT ended").agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v", "least").cast("decimal(20,0)"))).first()
        scratch.drop(walks)
        walks = after
        if open_now == 0 or (open_now == open_before and least_now == least_before):
            break
        open_before, least_before = open_now, least_now
    both = walks.groupBy("u").agg(F.min("b").alias("end1"), F.max("b").alias("end2"), F.min("least").alias("least"), F.bool_and("ended").alias("ended"))
    both = scratch.cut(both.withColumnRenamed("u", "v"), "ranked")
    chains = both.where("ended")
    rings = both.where("NOT ended AND v <> least").select("v", F.col("least").alias("to"))
    pointers = chains.select("v", F.col("end1").alias("to")).unionByName(rings)
    gone = both.select("v")
    kept = edges.join(gone.withColumnRenamed("v", "x"), "x", "left_anti").join(gone.withColumnRenamed("v", "y"), "y", "left_anti").select("x", "y")
    links = chains.where("end1 <> end2").select(F.col("end1").alias("x"), F.col("end2").alias("y"))
    return pointers, kept.unionByName(links).distinct(), True


def _core(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) of the core: alternating large and small stars until every vertex hangs on its component's least vertex."""
    stars = edges.select(F.col("y").alias("u"), F.col("x").alias("v"))  # u > v
    before = None
    for _ in range(CORE_ROUNDS):
        near = _darts(stars.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = scratch.cut(small, "stars")
        state = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        stars = small
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the core's components did not settle")
    roots = stars.select(F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(roots.select(F.col("root").alias("v"), "root"))


def match_groups(pairs: DataFrame, a: str, b: str, *, rounds: int = 8) -> DataFrame:
    """(group_id, member): each vertex of a group of two or more, group_id being the group's least member.

    Pairs count in either direction, repeated or not; pairs with a null end or two equal ends tie nothing. At most ``rounds``
    rounds of stripping and compressing are made; the rest is the core, so any value gives the same groups.
    An empty table gives no rows.
    """
    scratch = Scratch(pairs.sparkSession, "groups")
    edges = scratch.cut(undirected(pairs, a, b), "pairs")
    vertices = _darts(edges).select(F.col("u").alias("v")).distinct()
    removed: list[DataFrame] = []
    rest = edges
    for _ in range(rounds):
        pointers, rest = _strip(rest, scratch)
        removed.append(pointers)
        pointers, rest, _some = _compress(rest, scratch)
        if _some:
            rest = scratch.cut(rest, "rest")
            removed.append(pointers)
        if rest.isEmpty():
            break
        ends = _ends(rest).where("degree < 3")
        if ends.isEmpty():
            break
    labels = None if rest.isEmpty() else scratch.cut(_core(rest, scratch), "core")
    for pointers in reversed(removed):
        if labels is None:
            labels = pointers.select("v", F.col("to").alias("root")).unionByName(pointers.select(F.col("to").alias("v"), F.col("to").alias("root")).distinct())
            labels = scratch.cut(labels, "labels")
            continue
        hung = pointers.join(labels.withColumnRenamed("v", "to"), "to", "left").select("v", F.coalesce("root", "to").alias("root"), "to", F.col("root").isNull().alias("new"))
        hung = scratch.cut(hung, "hung")
        labels = labels.unionByName(hung.select("v", "root")).unionByName(hung.where("new").select(F.col("to").alias("v"), F.col("to").alias("root")).distinct())
    if labels is None:
        return vertices.select(F.col("v").alias("group_id"), F.col("v").alias("member"))  # no pairs at all
    labels = scratch.cut(labels, "labels")
    least = labels.groupBy("root").agg(F.min("v").alias("group_id"))
    return labels.join(least, "root").select("group_id", F.col("v").alias("member"))
