"""Parent-child links of unknown depth: descendant lists, depths, roots, paths and cycles by leaf peeling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..scratch import Scratch

SMALL_ROWS = 50_000  # a side with at most this many (id, id) rows may be broadcast
WORTH = 0.25  # share of the links left that a peeling round must remove to be followed by another


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast if its counted size is within the bound."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


@dataclass
class Peeled:
    """``edges``: (child, parent, child_height, parent_height), self links and repeats removed, height null on nodes of the
    residue; ``heights``: number of peeling rounds; ``loops``: (node) of links from a node to itself; ``stuck``: whether there is a residue."""

    edges: DataFrame
    heights: int
    loops: DataFrame
    stuck: bool


def clean_links(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, parent) distinct; rows with a null end are dropped."""
    return links.select(F.col(child).alias("child"), F.col(parent).alias("parent")).where("child IS NOT NULL AND parent IS NOT NULL").distinct()


def peel(links: DataFrame, scratch: Scratch, *, child: str = "child", parent: str = "parent") -> Peeled:
    """Heights by bottom-up leaf peeling: in each round the nodes without remaining children are removed.

    A link survives a round when its child has a child of its own among the links left; a node's height is the number of
    rounds it began as a parent. Peeling ends when no link is left, or when a round removes less than ``WORTH`` of those
    left: what remains, cycles and what lies above them, long chains and other tall and thin stretches, is the residue, whose parents keep a
    null height. So rounds grow with the logarithm of the number of links, not with the height. Each round is one job over the links
    left; its row count comes with the write.
    """
    spark = scratch.spark
    every = scratch.cut(clean_links(links, child, parent), "links")
    loops = every.where("child = parent").select(F.col("child").alias("node"))
    kind = every.schema["child"].dataType.simpleString()
    place = scratch.path("rounds")
    left, height, stuck = every.where("child <> parent"), 0, False
    alive = None
    while True:
        if height == 0:
            kept = left
        else:
            parents = left.select(F.col("parent").alias("child"))
            kept = left.join(_bounded(parents, alive) if alive <= SMALL_ROWS else parents.distinct(), "child", "left_semi").select("child", "parent")
        seen = Observation()
        kept.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{place}/round={height}")
        remaining = seen.get["n"]
        if remaining == 0:
            break
        if alive is not None and remaining > (1 - WORTH) * alive:
            stuck = True
            break
        alive = remaining
        left = spark.read.schema(f"child {kind}, parent {kind}").parquet(f"{place}/round={height}")
        height += 1
    rounds = spark.read.schema(f"child {kind}, parent {kind}, round int").parquet(place)
    top = rounds.groupBy(F.col("parent").alias("node")).agg(F.max("round").alias("last"))
    top = top.select("node", F.when(F.lit(not stuck) | (F.col("last") < height), F.col("last") + 1).alias("height"))
    top = scratch.cut(top, "heights")
    parents = top.select(F.col("node").alias("parent"), F.col("height").alias("parent_height"))
    children = top.select(F.col("node").alias("child"), F.col("height").alias("child_height"), F.lit(True).alias("_inner"))
    out = (
        every.where("child <> parent")
        .join(parents, "parent")
        .join(children, "child", "left")
        .select("child", "parent", F.when(F.col("_inner").isNull(), F.lit(0)).otherwise(F.col("child_height")).alias("child_height"), "parent_height")
    )
    out = scratch.cut(out, "edges", ["child_height"])
    highest = out.agg(F.max("parent_height")).first()[0] or 0
    return Peeled(out, highest, loops, stuck)


def descendants(peeled: Peeled, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Every node reached downward, as (ways, selves, residue). ways: (node, descendant, distance), in which the smallest distance of a pair
    is the smallest number of links; selves: (node) that reach themselves; residue: (top, node, far), the ways within the residue, if there is one.

    A peeled node merges the lists of its children, each one link longer, and sends its own list on to its parents. A message is
    written once into the folder of its receiver's height and read once in that height's round. The ways within the residue
    come from ``_doubled``; the lists that reach the residue are handed along them once.
    """
    spark, edges = scratch.spark, peeled.edges
    stuck_height = peeled.heights + 1
    target = F.coalesce(F.col("parent_height"), F.lit(stuck_height))
    kind = edges.schema["child"].dataType.simpleString()
    schema = f"node {kind}, descendant {kind}, distance int"
    place = scratch.path("messages")
    box = ["node", "descendant", "distance"]

    def send(messages: DataFrame) -> None:
        messages.select(*box, "at").write.mode("append").partitionBy("at").parquet(place)

    def inbox(height: int) -> DataFrame:
        read = spark.read.schema(schema + ", at int").parquet(place).where(F.col("at") == height).select(*box)
        return read.groupBy("node", "descendant").agg(F.min("distance").alias("distance"))

    # every link is itself a message: the child tells its parents of itself
    outside = edges.where("child_height IS NOT NULL OR parent_height IS NOT NULL")
    send(outside.select(F.col("parent").alias("node"), F.col("child").alias("descendant"), F.lit(1).alias("distance"), target.alias("at")))
    per_height = {r["child_height"]: r["n"] for r in edges.where("child_height > 0").groupBy("child_height").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per height
    for height in range(1, peeled.heights + 1):
        if per_height.get(height):
            up = edges.where(F.col("child_height") == height).select(F.col("child").alias("node"), "parent", target.alias("at"))
            send(inbox(height).join(_bounded(up, per_height[height]), "node").select(F.col("parent").alias("node"), "descendant", (F.col("distance") + 1).alias("distance"), "at"))
    whole = spark.read.schema(schema + ", at int").parquet(place).select(*box)
    if not peeled.stuck:
        return whole, whole.select("node").limit(0), None
    known, n_known = _doubled(edges.where("child_height IS NULL AND parent_height IS NULL").select("child", "parent"), scratch)
    handed = inbox(stuck_height).join(_bounded(known, n_known), "node").select(F.col("top").alias("node"), "descendant", (F.col("distance") + F.col("far")).alias("distance"))
    whole = whole.unionByName(known.select(F.col("top").alias("node"), F.col("node").alias("descendant"), F.col("far").alias("distance"))).unionByName(handed)
    return whole, known.where("top = node").select("node"), known


def _doubled(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """((top, node, far), rows): all ways along ``links`` (child, parent), far the smallest number of links; written.

    Each round doubles the distance covered: a way of up to 2L links is a shortest one of exactly L links and one of up to L more,
    so only ways of exactly L are joined with the rest, and rounds grow with the logarithm of the longest way, on cycles too.
    """
    known, n = scratch.counted(links.select(F.col("parent").alias("top"), F.col("child").alias("node"), F.lit(1).alias("far")), "ways")
    reach = 1
    while n:
        first = known.where(F.col("far") == reach).select(F.col("top").alias("via"), "node")
        then = known.select("top", F.col("node").alias("via"), F.col("far").alias("more"))
        longer = first.join(then, "via").select("top", "node", (F.col("more") + reach).alias("far"))
        after, n_after = scratch.counted(known.unionByName(longer).groupBy("top", "node").agg(F.min("far").alias("far")), "ways")
        scratch.drop(known)
        known, before, n, reach = after, n, n_after, 2 * reach
        if n == before:
            break
    return known, n


def _residue_places(known: DataFrame, links: DataFrame, tops: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, depth, root, path) of the residue's nodes below ``tops`` (node): depths from the ways, parents by least depth and id, paths by
    pointer jumping, each round doubling the stretch of path known."""
    own = tops.select("node", F.lit(0).alias("depth"))
    depth = scratch.cut(known.join(tops.withColumnRenamed("node", "top"), "top", "left_semi").groupBy("node").agg(F.min("far").alias("depth")).unionByName(own), "depths")
    above = links.join(depth.select(F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth")), "parent").join(depth.withColumnRenamed("node", "child"), ["child", "depth"])
    chosen = above.groupBy("child").agg(F.min("parent").alias("next")).withColumnRenamed("child", "node")
    stretch, n_open = scratch.measured(own.select("node", F.lit(None).cast(own.schema["node"].dataType).alias("next")).unionByName(chosen).withColumn("path", F.array("node")), "stretches", n=F.count("next"))
    while n_open["n"]:
        higher = stretch.select(F.col("node").alias("next"), F.col("next").alias("_next"), F.col("path").alias("_path"))
        after = stretch.join(higher, "next", "left").select("node", F.col("_next").alias("next"), F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path"))
        longer, n_open = scratch.measured(after, "stretches", n=F.count("next"))
        scratch.drop(stretch)
        stretch = longer
    return stretch.select("node", (F.size("path") - 1).alias("depth"), F.element_at("path", 1).alias("root"), "path")


def all_descendants(links: DataFrame, *, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, descendant, distance): every node reached downward with the smallest number of links, a node on a cycle with itself among them.

    Rows with a null end are dropped, repeats count once; an empty table gives no rows.
    """
    scratch = Scratch(links.sparkSession, "descendants")
    peeled = peel(links, scratch, child=child, parent=parent)
    ways, _, _ = descendants(peeled, scratch)
    loops = peeled.loops.select("node", F.col("node").alias("descendant"), F.lit(1).alias("distance"))
    return ways.unionByName(loops).groupBy("node", "descendant").agg(F.min("distance").alias("distance"))


def hierarchy(links: DataFrame, *, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, depth, root, path, n_descendants, on_cycle), one row per node that occurs in a link.

    depth is the smallest number of links up to a root; with several parents the path follows the parent of least depth,
    then least id. Paths are arrays of ids from the root to the node. Peeled nodes get theirs in reverse peel order, those of the
    residue before by ``_residue_places``. Nodes
    on a cycle, and nodes all of whose upward ways come from one, have null depth, root and path. Links of a node to itself
    count as cycles only. Rows with a null end are dropped, repeats count once; an empty table gives no rows.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    peeled = peel(links, scratch, child=child, parent=parent)
    ways, selves, residue = descendants(peeled, scratch)
    cyclic = scratch.cut(selves.unionByName(peeled.loops).distinct(), "cyclic")
    sizes = ways.where("node <> descendant").select("node", "descendant").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("n_descendants"))
    edges = peeled.edges
    nodes = edges.select(F.col("child").alias("node"), F.col("child_height").alias("height")).unionByName(edges.select("parent", "parent_height").toDF("node", "height")).unionByName(peeled.loops.withColumn("height", F.lit(None).cast("int")))
    nodes = scratch.cut(nodes.groupBy("node").agg(F.max("height").alias("height")), "nodes")
    tops = nodes.join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti").join(cyclic, "node", "left_anti")
    placed = scratch.cut(tops.select("node", F.lit(0).alias("depth"), F.col("node").alias("root"), F.array("node").alias("path"), "height"), "placed")
    # down the links: a placed node offers its place to its children; an offer is written once, into the box of the child's height
    down = scratch.cut(edges.select("child", F.col("parent").alias("node"), F.coalesce("child_height", F.lit(-1)).alias("at"), F.coalesce("parent_height", F.lit(-1)).alias("parent_height")), "down", ["parent_height"])
    place = scratch.path("offers")
    kind = edges.schema["child"].dataType.simpleString()
    offer = f"child {kind}, depth int, node {kind}, root {kind}, path array<{kind}>"

    def send(rows: DataFrame, links: DataFrame) -> None:
        rows.join(links, "node").select("child", "depth", "node", "root", "path", "at").write.mode("append").partitionBy("at").parquet(place)

    def best(offers: DataFrame) -> DataFrame:
        won = offers.groupBy("child").agg(F.min(F.struct("depth", "node", "root", "path")).alias("b"))
        return won.select(F.col("child").alias("node"), (F.col("b.depth") + 1).alias("depth"), F.col("b.root").alias("root"), F.concat("b.path", F.array("child")).alias("path"))

    stuck_placed = placed.where("height IS NULL").drop("height")
    if residue is not None:
        inner = edges.where("child_height IS NULL AND parent_height IS NULL").select("child", "parent")
        stuck_placed = scratch.cut(_residue_places(residue, inner, stuck_placed.select("node"), scratch), "residue")
    send(stuck_placed, down.where("parent_height = -1 AND at >= 0").drop("parent_height"))
    send(placed.where("height IS NOT NULL"), down.where("parent_height >= 0").drop("parent_height"))
    # reverse peel order: a node's parents are all higher, so its box is complete when its height comes
    for height in range(peeled.heights, 0, -1):
        send(best(spark.read.schema(offer + ", at int").parquet(place).where(F.col("at") == height).drop("at")), down.where(F.col("parent_height") == height).drop("parent_height"))
    every = placed.drop("height").unionByName(stuck_placed.join(placed.select("node"), "node", "left_anti")).unionByName(best(spark.read.schema(offer + ", at int").parquet(place).drop("at")))
    on_cycle = cyclic.withColumn("on_cycle", F.lit(True))
    out = nodes.select("node").join(every, "node", "left").join(sizes, "node", "left").join(on_cycle, "node", "left")
    plain = F.col("on_cycle").isNull()
    return out.select("node", *[F.when(plain, F.col(c)).alias(c) for c in ("depth", "root", "path")], F.coalesce("n_descendants", F.lit(0).cast("long")).alias("n_descendants"), F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def closure_findings(links: DataFrame, stated: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, finding): 'cycle' for nodes that reach themselves, 'level' where ``stated`` differs from the links.

    ``links``: (child, parent). ``stated``: (ancestor, descendant, distance) as another table has it; its self rows are left out and
    repeats count once. ``nodes``: (node), the nodes that may be reported. Null ends of links are dropped; a stated row
    with a null distance never equals a reached one. Empty inputs give no rows.
    """
    scratch = Scratch(links.sparkSession, "closure")
    peeled = peel(links, scratch)
    ways, selves, _ = descendants(peeled, scratch)
    cycles = selves.unionByName(peeled.loops).distinct().withColumn("finding", F.lit("cycle"))
    # one aggregation instead of an outer join: a pair is in order if both sides know it and all distances are the same
    none = F.lit(None).cast("int")
    real = ways.where("node <> descendant").select(F.col("node").alias("ancestor"), "descendant", F.col("distance").cast("int").alias("real"), none.alias("said"), F.lit(False).alias("unclear"))
    said = stated.where("descendant IS NOT NULL AND NOT (ancestor <=> descendant)").select("ancestor", "descendant", none.alias("real"), F.col("distance").cast("int").alias("said"), F.col("distance").isNull().alias("unclear"))
    pairs = real.unionByName(said).groupBy("descendant", "ancestor").agg(F.min("real").alias("real"), F.min("said").alias("said"), F.max("said").alias("most"), F.bool_or("unclear").alias("unclear"))
    level = pairs.where("unclear OR NOT (real <=> said) OR NOT (said <=> most)").select(F.col("descendant").alias("node")).distinct().withColumn("finding", F.lit("level"))
    return cycles.unionByName(level).join(nodes.select("node").distinct(), "node", "left_semi")
