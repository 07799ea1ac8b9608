"""Common parents of groups of concepts, and small sets of parents that cover a group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .edges import EdgeFilter


def standardise_ids(edges: DataFrame, ids: DataFrame, *, within_domain: bool = True) -> DataFrame:
    """(concept_id, standard_id): the least valid 'Maps to' target of each of the distinct ``ids``, else the id itself."""
    maps = edges.where(EdgeFilter(predicate="Maps to", within_domain=within_domain).condition()).groupBy(F.col("subject_id").alias("concept_id")).agg(F.min("object_id").alias("_to"))
    own = ids.select("concept_id").dropna().distinct()
    return own.join(maps, "concept_id", "left").select("concept_id", F.coalesce("_to", "concept_id").alias("standard_id"))


def one_hop(edges: DataFrame, predicate: str) -> DataFrame:
    """(node, other) of the valid same-domain edges of one predicate, links to itself left out."""
    return edges.where(EdgeFilter(predicate=predicate).condition()).where("subject_id <> object_id").select(F.col("subject_id").alias("node"), F.col("object_id").alias("other")).distinct()


def parent_search(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(concept_id, parent_id): one step over 'Is a'."""
    own = ids.select(F.col("concept_id").alias("node")).dropna().distinct()
    return one_hop(edges, "Is a").join(own, "node", "left_semi").select(F.col("node").alias("concept_id"), F.col("other").alias("parent_id"))


def subsumes_closure(edges: DataFrame, roots: DataFrame, barriers: DataFrame | None = None) -> DataFrame:
    """(group_id, root, node): all nodes below each root over 'Subsumes', for ``roots`` (group_id, root).

    Nodes of ``barriers`` (group_id, node) are included but not passed, except that a root is always expanded. The root itself
    is in its closure only if it lies on a cycle. Each round extends all roots by one level.
    """
    scratch = Scratch(edges.sparkSession, "closure")
    down = scratch.cut(one_hop(edges, "Subsumes"), "links")
    key = ["group_id", "root", "node"]
    frontier = scratch.cut(roots.select("group_id", "root").dropna().distinct().withColumn("node", F.col("root")), "roots")
    every = None
    while True:
        step = frontier.join(down, "node").select("group_id", "root", F.col("other").alias("node")).distinct()
        fresh = scratch.cut(step if every is None else step.join(every, key, "left_anti"), "level")
        if fresh.isEmpty():
            break
        every = fresh if every is None else every.unionByName(fresh)
        frontier = fresh if barriers is None else fresh.join(barriers.select("group_id", "node"), ["group_id", "node"], "left_anti")
    return frontier.select(*key).limit(0) if every is None else every


@dataclass(frozen=True)
class CommonParents:
    """stats: (group_id, parent_id, coverage, pollution, purity, completeness, max_depth); found: (group_id, parent_id, origin), the seeds
    below each parent; descendants: (group_id, parent_id, node), those and the closure."""

    stats: DataFrame
    found: DataFrame
    descendants: DataFrame


def common_parents(edges: DataFrame, seeds: DataFrame, *, min_coverage: int = 2, max_up_depth: int | None = None, standardise_seeds: bool = False) -> CommonParents:
    """Parents shared by the seeds of each group, for ``seeds`` (group_id, concept_id); repeated seeds count once.

    From every seed upward over 'Is a' (a node of a group is reached once per seed), as far as ``max_up_depth`` or the top.
    Parents are taken to their standard concept and merged. coverage: seeds below; pollution: closure members that aren't seeds, the
    closure not passing seeds; purity: coverage / (coverage + pollution); completeness: coverage / seeds; max_depth: the greatest depth at which
    a seed's search met it. Seeds that map to a standard concept count as themselves; with ``standardise_seeds`` their
    standard concepts count as seeds too where pollution is concerned.
    """
    scratch = Scratch(edges.sparkSession, "parents")
    up = scratch.cut(one_hop(edges, "Is a"), "links")
    own = scratch.cut(seeds.select("group_id", "concept_id").dropna().distinct(), "seeds")
    frontier = own.select("group_id", F.col("concept_id").alias("origin"), F.col("concept_id").alias("node"))
    seen, evidence, depth = frontier, None, 0
    while max_up_depth is None or depth < max_up_depth:
        step = scratch.cut(frontier.join(up, "node").select("group_id", "origin", F.col("other").alias("node")).distinct().withColumn("depth", F.lit(depth + 1)), "step")
        if step.isEmpty():
            break
        evidence = step if evidence is None else evidence.unionByName(step)
        frontier = scratch.cut(step.select("group_id", "origin", "node").join(seen, ["group_id", "origin", "node"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
        depth += 1
    if evidence is None:
        evidence = frontier.withColumn("depth", F.lit(0)).limit(0)
    names = standardise_ids(edges, evidence.select(F.col("node").alias("concept_id"))).select(F.col("concept_id").alias("node"), F.col("standard_id").alias("parent_id"))
    facts = scratch.cut(evidence.join(names, "node").groupBy("group_id", "parent_id", "origin").agg(F.max("depth").alias("depth")), "facts")
    covered = facts.groupBy("group_id", "parent_id").agg(F.count(F.lit(1)).alias("coverage"), F.max("depth").alias("max_depth")).where(F.col("coverage") >= min_coverage)
    covered = scratch.cut(covered, "covered")
    barriers = own.select("group_id", F.col("concept_id").alias("node"))
    if standardise_seeds:
        standard = own.join(standardise_ids(edges, own), "concept_id").select("group_id", F.col("standard_id").alias("node"))
        barriers = barriers.unionByName(standard).distinct()
    below = subsumes_closure(edges, covered.select("group_id", F.col("parent_id").alias("root")), barriers)
    polluted = below.join(barriers, ["group_id", "node"], "left_anti").groupBy("group_id", F.col("root").alias("parent_id")).agg(F.count(F.lit(1)).alias("pollution"))
    sizes = own.groupBy("group_id").agg(F.count(F.lit(1)).alias("_seeds"))
    stats = covered.join(polluted, ["group_id", "parent_id"], "left").join(sizes, "group_id").withColumn("pollution", F.coalesce("pollution", F.lit(0).cast("long")))
    stats = stats.select("group_id", "parent_id", "coverage", "pollution", (F.col("coverage") / (F.col("coverage") + F.col("pollution"))).alias("purity"), (F.col("coverage") / F.col("_seeds")).alias("completeness"), "max_depth")
    found = facts.join(covered.select("group_id", "parent_id"), ["group_id", "parent_id"], "left_semi").select("group_id", "parent_id", "origin")
    descendants = found.select("group_id", "parent_id", F.col("origin").alias("node")).unionByName(below.select("group_id", F.col("root").alias("parent_id"), "node")).distinct()
    return CommonParents(stats, found, descendants)


def cover_score(gain, alpha: float = 1.0, beta: float = 1.0, gamma: float = 0.3, delta: float = 0.7):
    """What a parent is worth that covers ``gain`` more seeds."""
    return F.pow(gain, F.lit(alpha)) * F.pow("purity", F.lit(beta)) / (F.pow(1 + F.col("pollution"), F.lit(gamma)) * F.pow(1 + F.col("max_depth"), F.lit(delta)))


def greedy_cover(seeds: DataFrame, parents: CommonParents, *, target_ratio: float = 1.0, alpha: float = 1.0, beta: float = 1.0, gamma: float = 0.3, delta: float = 0.7, min_gain: int = 1, max_picks: int | None = None) -> DataFrame:
    """(group_id, pick_no, parent_id, gain, score): per group, again and again the parent of the best score on what is left.

    A group ends when the covered share of its distinct seeds reaches ``target_ratio``, or no parent gains ``min_gain``. Equal
    scores: the least parent_id. All groups pick in the same round; without ``max_picks`` a round takes every parent that leads on all it
    still covers (``_leading_picks``), not one per group.
    """
    scratch = Scratch(seeds.sparkSession, "cover")
    own = scratch.cut(seeds.select("group_id", F.col("concept_id").alias("origin")).dropna().distinct(), "seeds")
    sizes = own.groupBy("group_id").agg(F.count(F.lit(1)).alias("_seeds"))
    found, stats = scratch.cut(parents.found, "found"), scratch.cut(parents.stats, "stats")
    if max_picks is None and alpha >= 0:
        picks = _leading_picks(found, stats, lambda gain: cover_score(gain, alpha, beta, gamma, delta), min_gain, scratch)
        order = Window.partitionBy("group_id").orderBy(F.desc("score"), "parent_id")
        picks = picks.withColumn("pick_no", F.row_number().over(order)).withColumn("_before", F.sum("gain").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        return picks.join(sizes, "group_id").where(F.coalesce("_before", F.lit(0)) / F.col("_seeds") < target_ratio).select("group_id", "pick_no", "parent_id", "gain", "score")
    remaining, picks, pick_no = own, None, 0
    while max_picks is None or pick_no < max_picks:
        pick_no += 1
        open_groups = remaining.groupBy("group_id").agg(F.count(F.lit(1)).alias("_left")).join(sizes, "group_id").where((F.col("_seeds") - F.col("_left")) / F.col("_seeds") < target_ratio)
        gains = found.join(remaining, ["group_id", "origin"]).groupBy("group_id", "parent_id").agg(F.count(F.lit(1)).alias("gain")).where(F.col("gain") >= min_gain)
        scored = gains.join(open_groups.select("group_id"), "group_id", "left_semi").join(stats, ["group_id", "parent_id"]).withColumn("score", cover_score(F.col("gain"), alpha, beta, gamma, delta))
        best = scored.groupBy("group_id").agg(F.max_by(F.struct("parent_id", "gain", "score"), F.struct("score", -F.col("parent_id"))).alias("b"))
        best = scratch.cut(best.select("group_id", F.lit(pick_no).alias("pick_no"), "b.parent_id", "b.gain", "b.score"), "pick")
        if best.isEmpty():
            break
        picks = best if picks is None else picks.unionByName(best)
        taken = found.join(best.select("group_id", "parent_id"), ["group_id", "parent_id"], "left_semi").select("group_id", "origin")
        remaining = scratch.cut(remaining.join(taken, ["group_id", "origin"], "left_anti"), "left")
    return best.limit(0) if picks is None else picks


def _leading_picks(found: DataFrame, stats: DataFrame, score, min_gain: int, scratch: Scratch) -> DataFrame:
    """(group_id, parent_id, gain, score) of all picks, unordered.

    Scores only fall. So a parent that has the best score of all parents of each seed it still covers keeps its gain until its
    turn comes, and can be taken at once; in the order of score and id the picks are those made one at a time.
    """
    left = scratch.cut(found.join(stats.select("group_id", "parent_id", "purity", "pollution", "max_depth"), ["group_id", "parent_id"]), "cover")
    every = None
    while True:
        gains = left.groupBy("group_id", "parent_id", "purity", "pollution", "max_depth").agg(F.count(F.lit(1)).alias("gain")).where(F.col("gain") >= min_gain)
        scored = left.join(gains.select("group_id", "parent_id", "gain", score(F.col("gain")).alias("score")), ["group_id", "parent_id"])
        best = scored.groupBy("group_id", "origin").agg(F.max(F.struct("score", (-F.col("parent_id")).alias("minus_id"), "gain")).alias("b"))
        best = scratch.cut(best.select("group_id", "origin", (-F.col("b.minus_id")).alias("parent_id"), "b.gain", "b.score"), "best")
        lead = best.groupBy("group_id", "parent_id", "gain", "score").agg(F.count(F.lit(1)).alias("_n")).where("_n = gain").drop("_n")
        lead, n = scratch.counted(lead, "lead")
        every = lead if every is None else every.unionByName(lead)
        if not n:
            return every
        taken = best.join(lead.select("group_id", "parent_id"), ["group_id", "parent_id"], "left_semi").select("group_id", "origin")
        rest = scratch.cut(left.join(taken, ["group_id", "origin"], "left_anti"), "cover")
        scratch.drop(left, best)
        left = rest


def relate_groups(parents: CommonParents) -> DataFrame:
    """(group_id, from_id, to_id, type, overlap): within a group, each parent whose seeds are all below another one.

    Shared seeds are counted by an equi-join on the seed; equal sets give both directions. Parents compare only if they share a seed.
    """
    sizes = parents.found.groupBy("group_id", F.col("parent_id").alias("from_id")).agg(F.count(F.lit(1)).alias("_n"))
    a = parents.found.select("group_id", F.col("parent_id").alias("from_id"), "origin")
    b = parents.found.select("group_id", F.col("parent_id").alias("to_id"), "origin")
    shared = a.join(b, ["group_id", "origin"]).where("from_id <> to_id").groupBy("group_id", "from_id", "to_id").agg(F.count(F.lit(1)).alias("overlap"))
    return shared.join(sizes, ["group_id", "from_id"]).where("overlap = _n").select("group_id", "from_id", "to_id", F.lit("subsumed_by").alias("type"), "overlap")
