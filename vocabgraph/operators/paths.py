"""All shortest paths between many pairs of nodes at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .edges import EdgeFilter
from .traverse import reach_levels

OUT, BACK = "forward", "backward"
STATE = ["pair_id", "side", "node", "depth", "fan", "fresh"]
STEP = "struct<subject:bigint,predicate:string,object:bigint>"
#: nodes with more links than that are walked by asking for the links to nodes that lead on, not by opening them for every pair
HUB = 1000


@dataclass(frozen=True)
class ShortestPaths:
    """paths: (pair_id, path_no, hops, steps); summary: (pair_id, hops, reason); expansions: (pair_id, side, depth, node), the nodes both
    searches opened; trace: those with the edges they met (subject_id, predicate_id, object_id)."""

    paths: DataFrame
    summary: DataFrame
    expansions: DataFrame
    trace: DataFrame


def shortest_paths(edges: DataFrame, pairs: DataFrame, *, rule: EdgeFilter | None = None, max_depth: int = 6, max_paths: int = 20) -> ShortestPaths:
    """All shortest directed paths of at most ``max_depth`` steps for ``pairs`` (pair_id, source, target), up to ``max_paths`` per pair.

    Two searches per pair close in on each other. Each round is one join in which every open pair moves the side that has fewer
    steps ahead (the source's on ties), so a hub among the targets isn't opened while the other side is cheap, and no
    pair's search depends on the others. A pair leaves when its searches meet. Only edges on some shortest path are then
    walked; every prefix kept leads to the target, so capping each level by the order of steps gives the first ``max_paths`` of all.
    Parallel predicates are paths of their own, no path comes twice. source = target gives one path without steps. Pairs with a
    null end are dropped, repeats of a pair_id count once.
    """
    rule = rule or EdgeFilter()
    scratch = Scratch(edges.sparkSession, "paths")
    links = scratch.cut(edges.where(rule.condition()).select(F.col("subject_id").alias("s"), F.col("predicate_id").alias("p"), F.col("object_id").alias("o")).dropna().distinct(), "links")
    hops = links.select("s", "o").distinct()
    ways = scratch.cut(hops.select(F.lit(OUT).alias("side"), F.col("s").alias("node"), F.col("o").alias("next")).unionByName(hops.select(F.lit(BACK).alias("side"), F.col("o").alias("node"), F.col("s").alias("next"))), "ways")
    fan = ways.groupBy("side", "node").agg(F.count(F.lit(1)).alias("fan"))
    asked = scratch.cut(pairs.select("pair_id", "source", "target").dropna().dropDuplicates(["pair_id"]), "pairs")
    open_pairs = asked.where("source <> target")
    first = open_pairs.select("pair_id", F.explode(F.array(F.struct(F.lit(OUT).alias("side"), F.col("source").alias("node")), F.struct(F.lit(BACK).alias("side"), F.col("target").alias("node")))).alias("x"))
    first = first.select("pair_id", "x.side", "x.node", F.lit(0).alias("depth"), F.lit(True).alias("fresh"))
    # a state holds the frontiers of both sides of every open pair; fresh rows are those the last round reached
    state = scratch.cut(first.join(fan, ["side", "node"], "left").select(*STATE), "state-0")
    reached = state.where("fresh").select("pair_id", "side", "node", "depth")
    met: list[DataFrame] = []  # (pair_id, node, hops, turn), turn: depth of the search from the source at the meeting
    moves: list[DataFrame] = []
    for total in range(1, max_depth + 1):
        now = state.join(met[-1].select("pair_id"), "pair_id", "left_anti") if met else state
        ahead = lambda side: F.sum(F.when(F.col("side") == side, F.coalesce("fan", F.lit(0))))
        choice = now.groupBy("pair_id").agg(ahead(OUT).alias("_out"), ahead(BACK).alias("_back")).where("_out IS NOT NULL AND _back IS NOT NULL")
        tagged = now.join(choice.select("pair_id", F.when(F.col("_out") <= F.col("_back"), OUT).otherwise(BACK).alias("move")), "pair_id")
        moving = tagged.where("side = move")
        moves.append(moving.select("pair_id", "side", "depth", "node"))
        step = moving.join(ways, ["side", "node"]).select("pair_id", "side", F.col("next").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        step = step.join(reached, ["pair_id", "side", "node"], "left_anti").join(fan, ["side", "node"], "left").withColumn("fresh", F.lit(True))
        stay = tagged.where("side <> move").withColumn("fresh", F.lit(False))
        state, seen = scratch.measured(step.select(*STATE).unionByName(stay.select(*STATE)), f"state-{total}", fresh=F.sum(F.col("fresh").cast("int")))
        if not seen["fresh"]:
            break
        reached = reached.unionByName(state.where("fresh").select("pair_id", "side", "node", "depth"))
        both = state.groupBy("pair_id", "node").agg(F.max(F.when(F.col("side") == OUT, F.col("depth"))).alias("turn"), F.max(F.when(F.col("side") == BACK, F.col("depth"))).alias("_back"))
        meeting, n_met = scratch.counted(both.where("turn IS NOT NULL AND _back IS NOT NULL").select("pair_id", "node", F.lit(total).alias("hops"), "turn"), "met")
        if n_met:
            met.append(meeting)
    empty = F.array().cast(f"array<{STEP}>")
    every = asked.where("source = target").select("pair_id", F.lit(0).alias("hops"), empty.alias("steps"))
    if met:
        every = every.unionByName(_walk(asked, links, hops, reached, reduce(DataFrame.unionByName, met), max_paths, scratch))
    every = every.withColumn("path_no", F.row_number().over(Window.partitionBy("pair_id").orderBy("steps"))).select("pair_id", "path_no", "hops", "steps")
    lengths = every.where("path_no = 1").select("pair_id", "hops")
    reason = F.when(F.col("source") == F.col("target"), "source_equals_target").when(F.col("hops").isNull(), "no_path").otherwise("shortest_paths_found")
    summary = asked.join(lengths, "pair_id", "left").select("pair_id", "hops", reason.alias("reason"))
    expansions = reduce(DataFrame.unionByName, moves) if moves else reached.select("pair_id", "side", "depth", "node").limit(0)
    darts = links.select(F.lit(OUT).alias("side"), F.col("s").alias("node"), "s", "p", "o").unionByName(links.select(F.lit(BACK).alias("side"), F.col("o").alias("node"), "s", "p", "o"))
    trace = expansions.join(darts, ["side", "node"]).select("pair_id", "side", "depth", "node", F.col("s").alias("subject_id"), F.col("p").alias("predicate_id"), F.col("o").alias("object_id"))
    return ShortestPaths(every, summary, expansions, trace)


def _walk(asked: DataFrame, links: DataFrame, hops: DataFrame, reached: DataFrame, met: DataFrame, max_paths: int, scratch: Scratch) -> DataFrame:
    """(pair_id, hops, steps) of the pairs in ``met``: the useful nodes of each depth are swept back from the meetings, then walked."""
    meta = scratch.cut(met.select("pair_id", "hops", "turn").distinct(), "meta")
    last, most = meta.agg(F.max("turn"), F.max("hops")).first()
    known = scratch.cut(reached.join(meta, "pair_id"), "reached", ["side"])
    fans = hops.groupBy(F.col("s").alias("hub")).agg(F.count(F.lit(1)).alias("n"), F.lit(OUT).alias("side")).unionByName(hops.groupBy(F.col("o").alias("hub")).agg(F.count(F.lit(1)).alias("n"), F.lit(BACK).alias("side")))
    wide, n_wide = scratch.counted(fans.where(F.col("n") > HUB).select("side", "hub"), "hubs")
    hubs = lambda side: wide.where(F.col("side") == side).select("hub") if n_wide else None
    forward = known.where(F.col("side") == OUT)
    useful: DataFrame | None = None
    parts = []
    for depth in range(last, -1, -1):
        here = met.where(F.col("turn") == depth).select("pair_id", "node")
        if useful is not None:
            level = forward.where(F.col("depth") == depth).select("pair_id", "node")
            few, many = _split(useful, hubs(BACK))
            back = few.join(hops, F.col("node") == F.col("o")).select("pair_id", F.col("s").alias("node")).distinct()
            back = level.join(back, ["pair_id", "node"], "left_semi")
            if many is not None:
                asked_for = level.withColumnRenamed("node", "s").join(many.withColumnRenamed("node", "o"), "pair_id").join(hops, ["s", "o"], "left_semi")
                back = back.unionByName(asked_for.select("pair_id", F.col("s").alias("node"))).distinct()
            here = here.unionByName(back)
        useful = scratch.cut(here, f"useful-{depth}")
        parts.append(useful.select("pair_id", "node", F.lit(depth).alias("depth")))
    # allowed at a depth: useful nodes up to the meeting, then the nodes that are as far from the target as steps are left
    parts.append(known.where(F.col("side") == BACK).where("hops - depth > turn").select("pair_id", "node", (F.col("hops") - F.col("depth")).alias("depth")))
    allowed = scratch.cut(reduce(DataFrame.unionByName, parts), "allowed", ["depth"])
    paths = asked.join(meta, "pair_id").select("pair_id", "hops", F.col("source").alias("node"), F.array().cast(f"array<{STEP}>").alias("steps"))
    done = None
    order = Window.partitionBy("pair_id").orderBy("steps")
    for depth in range(1, most + 1):
        step = F.struct(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"))
        there = allowed.where(F.col("depth") == depth).select("pair_id", F.col("node").alias("o"))
        few, many = _split(paths.where(F.col("hops") >= depth), hubs(OUT))
        on = few.join(links, F.col("node") == F.col("s")).join(there, ["pair_id", "o"], "left_semi").select("pair_id", "hops", "s", "p", "o", "steps")
        if many is not None:
            on = on.unionByName(many.withColumnRenamed("node", "s").join(there, "pair_id").join(links, ["s", "o"]).select(*on.columns))
        paths = on.select("pair_id", "hops", F.col("o").alias("node"), F.concat("steps", F.array(step)).alias("steps"))
        paths = scratch.cut(paths.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= max_paths).drop("_no"), "walk")
        ended = paths.where(F.col("hops") == depth).select("pair_id", "hops", "steps")
        done = ended if done is None else done.unionByName(ended)
    return done


def _split(rows: DataFrame, hubs: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` whose node isn't among ``hubs``, and those whose is; all and None without hubs."""
    if hubs is None:
        return rows, None
    return rows.join(hubs, F.col("node") == F.col("hub"), "left_anti"), rows.join(hubs, F.col("node") == F.col("hub"), "left_semi")


def linked_shortest_paths(edges: DataFrame, pairs: DataFrame, *, rule: EdgeFilter | None = None, max_depth: int = 6, max_paths: int = 20) -> DataFrame:
    """The paths of ``shortest_paths`` for pairs most of which have a link from end to end.

    Such a pair has that link and its parallels as all its shortest paths, found for all pairs by one join; only the others are searched.
    """
    scratch = Scratch(edges.sparkSession, "linked")
    links = scratch.cut(edges.where((rule or EdgeFilter()).condition()).select("subject_id", "predicate_id", "object_id").dropna().distinct(), "links")
    asked = scratch.cut(pairs.select("pair_id", "source", "target").dropna().dropDuplicates(["pair_id"]), "pairs")
    ends = links.select(F.col("subject_id").alias("source"), "predicate_id", F.col("object_id").alias("target"))
    linked = asked.where("source <> target").join(ends, ["source", "target"]) if max_depth > 0 else asked.limit(0).withColumn("predicate_id", F.lit(""))
    step = F.struct(F.col("source").alias("subject"), F.col("predicate_id").alias("predicate"), F.col("target").alias("object"))
    linked = linked.withColumn("path_no", F.row_number().over(Window.partitionBy("pair_id").orderBy("predicate_id"))).where(F.col("path_no") <= max_paths)
    linked = scratch.cut(linked.select("pair_id", "path_no", F.lit(1).alias("hops"), F.array(step).alias("steps")), "linked")
    rest = scratch.cut(asked.join(linked.select("pair_id"), "pair_id", "left_anti"), "rest")
    found = shortest_paths(links, rest, rule=EdgeFilter(active_only=False, within_domain=False), max_depth=max_depth, max_paths=max_paths)
    return linked.unionByName(found.paths)


def paths_to_targets(edges: DataFrame, sources: DataFrame, targets: DataFrame, *, rule: EdgeFilter | None = None, max_depth: int = 6, max_paths: int = 20) -> DataFrame:
    """(source, target, path_no, hops, steps): the shortest paths of every (source) to every (target) it leads to in ``max_depth`` steps.

    For many sources and few targets: one backward search per target, shared by all sources, gives each node's distance to
    it; the sources met then walk down the distances. Nothing is made of pairs that aren't connected. Order and cap of paths
    are those of ``shortest_paths``. A source that is a target has a path without steps. Null ids are dropped.
    """
    rule = rule or EdgeFilter()
    scratch = Scratch(edges.sparkSession, "targets")
    links = scratch.cut(edges.where(rule.condition()).select(F.col("subject_id").alias("s"), F.col("predicate_id").alias("p"), F.col("object_id").alias("o")).dropna().distinct(), "links")
    back = links.select(F.col("o").alias("subject_id"), F.col("s").alias("object_id"))
    seeds = targets.select(F.col("target").alias("query_id"), F.col("target").alias("node"))
    levels = reach_levels(back, seeds, max_depth, scratch)
    ahead = reduce(DataFrame.unionByName, levels).select(F.col("query_id").alias("target"), "node", "depth")
    asked = sources.select(F.col("source").alias("node")).dropna().distinct()
    paths = scratch.cut(ahead.join(asked, "node").select(F.col("node").alias("source"), "target", F.col("depth").alias("hops"), "node", F.array().cast(f"array<{STEP}>").alias("steps")), "walked-0")
    order = Window.partitionBy("source", "target").orderBy("steps")
    # each step is written, so that no plan grows with the depth
    done = [paths.where("hops = 0")]
    for taken in range(1, len(levels)):
        step = F.struct(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"))
        near = ahead.where(F.col("depth") < len(levels) - taken).select("target", "node", (F.col("depth") + taken).alias("hops"))
        on = paths.where(F.col("hops") >= taken).join(links, F.col("node") == F.col("s")).select("source", "target", "hops", F.col("o").alias("node"), F.concat("steps", F.array(step)).alias("steps"))
        on = on.join(near, ["target", "node", "hops"], "left_semi").select(*paths.columns)
        paths = scratch.cut(on.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= max_paths).drop("_no"), f"walked-{taken}")
        done.append(paths.where(F.col("hops") == taken))
    paths = scratch.cut(reduce(DataFrame.unionByName, done), "walked")
    return paths.withColumn("path_no", F.row_number().over(order)).select("source", "target", "path_no", "hops", "steps")


def path_nodes(steps):
    """Array of a path's nodes: the first subject and every object; empty without steps."""
    objects = F.transform(steps, lambda x: x["object"])
    return F.when(F.size(steps) == 0, F.array().cast("array<bigint>")).otherwise(F.concat(F.array(steps[0]["subject"]), objects))


def path_text(steps):
    """'s|p|o' per step, joined by blanks and semicolons."""
    return F.array_join(F.transform(steps, lambda x: F.concat_ws("|", x["subject"].cast("string"), x["predicate"], x["object"].cast("string"))), "; ")
