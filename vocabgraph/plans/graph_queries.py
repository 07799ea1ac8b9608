"""The registered graph queries: each runs an operator over the whole vocabulary tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ATTRIBUTE, MAPPING, ONTOLOGICAL
from ..model import Predicate
from ..operators import edges as E
from ..operators import hierarchy as H
from ..operators import labels as L
from ..operators import lookup as K
from ..operators import phenotype as P
from ..operators.grounding import GroundingConstraints, ground_terms as ground
from ..operators.paths import linked_shortest_paths as search, path_text
from ..operators.shared import SharedPaths, shared_shortest_paths
from ..operators.resolvers import ExactLabelResolver, ExactSynonymResolver, PartialLabelResolver, ResolverConfidence, ResolverPipeline
from ..operators.scoring import COUNTERS, explain, path_profile as profile, rank_paths, ranked_paths_with_explanations
from ..operators.traverse import Traversal, traverse
from ..render import frames as R
from ..scratch import Scratch
from ..sources.tables import CONCEPT, VocabularyTables

ON = date(2015, 6, 30)
DEPTH, PAIR_DEPTH, MAX_NODES, MAX_PATHS, TOP = 3, 6, 50, 20, 5
DOMAIN, VOCABULARY = "Condition", "NORDA"
MAX_PARENTS = 100
GROUND_DOMAINS, GROUND_VOCABULARIES = ("Condition", "Drug"), ("CORE", "MEDEX", "NORDA")
WILD = ("acute%of", "l_ft", "%ic_mi%", "50%mg", "a_u%")

Q = tuple[SparkSession, str]


def _tables(spark: SparkSession, sf_dir: str) -> VocabularyTables:
    return VocabularyTables.from_parquet(spark, sf_dir)


def _texts(df: DataFrame, *dates: str) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) if c in dates else F.col(c) for c in df.columns])


def _all_ids(t: VocabularyTables) -> DataFrame:
    return t.concept.select("concept_id")


# lookups
def concept_view_batch(spark, sf_dir):
    t = _tables(spark, sf_dir)
    asked = t.concept_relationship.select(F.col("concept_id_1").alias("concept_id"))
    return _texts(K.concept_view(t, asked).select(*CONCEPT), "valid_start_date", "valid_end_date")


def concept_by_code(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return K.concept_id_by_code(t, t.concept)


def concept_synonyms(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return K.synonyms_of(t, t.concept_synonym)


def predicate_row(spark, sf_dir):
    return K.predicates(_tables(spark, sf_dir)).select("predicate_id", "name", "reverse_id", "is_hierarchical", "defines_ancestry")


def predicate_kind(spark, sf_dir):
    return K.predicates(_tables(spark, sf_dir)).select("predicate_id", "kind", "reason")


def predicate_reverse(spark, sf_dir):
    p = K.predicates(_tables(spark, sf_dir))
    back = p.select(F.col("predicate_id").alias("reverse_id"), F.col("name").alias("reverse_name"))
    return p.select("predicate_id", "reverse_id").join(back, "reverse_id", "left").select("predicate_id", "reverse_id", "reverse_name")


# edges
def _edges(spark, sf_dir, rule: E.EdgeFilter, direction: str = "out", extra: str | None = None) -> DataFrame:
    t = _tables(spark, sf_dir)
    every = E.enriched_edges(t)
    nodes = _all_ids(t).select(F.lit(0).alias("query_id"), F.col("concept_id").alias("node"))
    found = E.iter_edges(every if extra is None else every.where(extra), nodes, rule, direction=direction)
    return _texts(found.drop("query_id"), "valid_start_date", "valid_end_date")


def edges_out(spark, sf_dir):
    return _edges(spark, sf_dir, E.EdgeFilter(active_only=False, within_domain=False))


def edges_in(spark, sf_dir):
    return _edges(spark, sf_dir, E.EdgeFilter(active_only=False, within_domain=False), "in")


def edges_batch(spark, sf_dir):
    return _edges(spark, sf_dir, E.EdgeFilter(predicate="Maps to", active_only=False, within_domain=False))


def edges_active_on_date(spark, sf_dir):
    return _edges(spark, sf_dir, E.EdgeFilter(on=ON, within_domain=False))


def edges_by_kind(spark, sf_dir):
    return _edges(spark, sf_dir, E.EdgeFilter(kinds=(ONTOLOGICAL, MAPPING), within_domain=False))


def edges_same_domain(spark, sf_dir):
    return _edges(spark, sf_dir, E.EdgeFilter())


def edges_in_filtered(spark, sf_dir):
    """Incoming edges of two kinds, valid on a day, within the domain."""
    return _edges(spark, sf_dir, E.EdgeFilter(kinds=(ONTOLOGICAL, ATTRIBUTE), on=ON), "in")


def edges_of_predicate(spark, sf_dir):
    """Incoming edges of one predicate, given as the row that describes it."""
    return _edges(spark, sf_dir, E.EdgeFilter(predicate=Predicate("Subsumes", "Subsumes", "Is a", True, True, ONTOLOGICAL), within_domain=False), "in")


def edges_cross_domain(spark, sf_dir):
    return _edges(spark, sf_dir, E.EdgeFilter(within_domain=False), extra="NOT dangling AND NOT (subject_domain <=> object_domain)")


# hierarchy
def parents(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return H.parents(t, _all_ids(t))


def children(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return H.children(t, _all_ids(t))


def ancestors(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return H.ancestors(t, _all_ids(t))


def roots(spark, sf_dir):
    return H.roots(_tables(spark, sf_dir))


def standard_concepts(spark, sf_dir):
    """Standard concepts of one vocabulary and domain."""
    return H.standard_concepts(_tables(spark, sf_dir), vocabulary_id=VOCABULARY, domain_id=DOMAIN)


def leaves_vocabulary(spark, sf_dir):
    return H.leaves(_tables(spark, sf_dir), vocabulary_id=VOCABULARY)


def roots_domain(spark, sf_dir):
    return H.roots(_tables(spark, sf_dir), domain_id=DOMAIN)


def leaves(spark, sf_dir):
    return H.leaves(_tables(spark, sf_dir))


def singletons(spark, sf_dir):
    return H.singletons(_tables(spark, sf_dir))


# labels
def _entries(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/canonical_name.parquet").select(F.col("canonical_id").alias("term_id"), F.col("canonical_name").alias("text"))


def _first_words(spark, sf_dir) -> DataFrame:
    """One term per first word of an entry; the word itself is the id."""
    return _entries(spark, sf_dir).select(F.split("text", " ")[0].alias("text")).distinct().select(F.col("text").alias("term_id"), "text")


def label_exact(spark, sf_dir):
    return L.label_lookup(_tables(spark, sf_dir), _entries(spark, sf_dir))


def label_fuzzy(spark, sf_dir):
    return L.label_lookup(_tables(spark, sf_dir), _first_words(spark, sf_dir), fuzzy=True)


def synonym_exact(spark, sf_dir):
    return L.synonym_lookup(_tables(spark, sf_dir), _entries(spark, sf_dir))


def synonym_fuzzy(spark, sf_dir):
    return L.synonym_lookup(_tables(spark, sf_dir), _first_words(spark, sf_dir), fuzzy=True)


def _wild_terms(spark, sf_dir) -> DataFrame:
    return spark.createDataFrame([(w, w) for w in WILD], "term_id string, text string")


def label_wildcards(spark, sf_dir):
    """Terms in which % and _ stand for any letters."""
    return L.label_lookup(_tables(spark, sf_dir), _wild_terms(spark, sf_dir), fuzzy=True)


def label_wildcards_escaped(spark, sf_dir):
    """The same signs taken as they are, and the first words of the entries."""
    return L.label_lookup(_tables(spark, sf_dir), _wild_terms(spark, sf_dir).unionByName(_first_words(spark, sf_dir)), fuzzy=True, escape=True)


def label_ids_raw(spark, sf_dir):
    return L.concept_ids_by_label(_tables(spark, sf_dir), _entries(spark, sf_dir))


def label_rank(spark, sf_dir):
    t, terms = _tables(spark, sf_dir), _entries(spark, sf_dir)
    both = L.label_lookup(t, terms).unionByName(L.synonym_lookup(t, terms))
    return L.ranked_labels(both).select("term_id", "concept_id", "matched_label", "match_kind", F.col("rank_no").cast("long").alias("rank_no"))


# traversal
def _traverse(spark, sf_dir, on: date | None = None, max_nodes: int | None = None) -> tuple[VocabularyTables, Traversal]:
    """Down and up the hierarchy from all roots of each domain."""
    t = _tables(spark, sf_dir)
    seeds = H.roots(t).join(t.concept.select("concept_id", "domain_id"), "concept_id").select(F.col("domain_id").alias("query_id"), F.col("concept_id").alias("node"))
    return t, traverse(E.enriched_edges(t), seeds, rule=E.EdgeFilter(kinds=(ONTOLOGICAL,), on=on), max_depth=DEPTH, max_nodes=max_nodes)


def traverse_nodes(spark, sf_dir):
    return _traverse(spark, sf_dir)[1].nodes.select("query_id", "node", F.col("depth").cast("long").alias("depth"), "expanded")


def traverse_edges(spark, sf_dir):
    return _traverse(spark, sf_dir)[1].edges.select("query_id", "subject_id", "predicate_id", "object_id")


def traverse_on_date(spark, sf_dir):
    return _traverse(spark, sf_dir, on=ON)[1].nodes.select("query_id", "node", F.col("depth").cast("long").alias("depth"))


def traverse_max_nodes(spark, sf_dir):
    found = _traverse(spark, sf_dir, max_nodes=MAX_NODES)[1]
    return found.nodes.join(found.summary, "query_id").select("query_id", "node", F.col("depth").cast("long").alias("depth"), "expanded", "terminated_reason")


def traverse_trace(spark, sf_dir):
    return _traverse(spark, sf_dir)[1].trace.select("query_id", F.col("step_no").cast("long").alias("step_no"), F.col("depth").cast("long").alias("depth"), "node", "predicate_id", "object_id")


# paths
def _stated_pairs(t: VocabularyTables) -> DataFrame:
    """Every stated (descendant, ancestor), self rows too."""
    rows = t.concept_ancestor.select(F.col("descendant_concept_id").alias("source"), F.col("ancestor_concept_id").alias("target"))
    return rows.withColumn("pair_id", F.concat_ws(">", "source", "target"))


UPWARD = E.EdgeFilter(kinds=(ONTOLOGICAL,), within_domain=False)


def _upward_shared(spark, sf_dir, max_paths: int = MAX_PATHS) -> tuple[VocabularyTables, SharedPaths]:
    """Over the hierarchy in both directions and across domains, by shared searches; pairs may have several paths."""
    t = _tables(spark, sf_dir)
    return t, shared_shortest_paths(E.enriched_edges(t), _stated_pairs(t), rule=UPWARD, max_depth=PAIR_DEPTH, max_paths=max_paths)


def shortest_path_length(spark, sf_dir):
    return _upward_shared(spark, sf_dir)[1].summary.select("pair_id", F.col("hops").cast("long").alias("hops"), "reason")


def shortest_paths(spark, sf_dir):
    return _upward_shared(spark, sf_dir)[1].paths().select("pair_id", F.col("path_no").cast("long").alias("path_no"), path_text(F.col("steps")).alias("steps"))


def shortest_paths_capped(spark, sf_dir):
    return _upward_shared(spark, sf_dir, max_paths=1)[1].paths().select("pair_id", path_text(F.col("steps")).alias("steps"))


def shortest_paths_parallel(spark, sf_dir):
    """Over any predicate, between the ends of every 'Maps to' row: links of other kinds are paths of their own."""
    t = _tables(spark, sf_dir)
    ends = t.concept_relationship.where("relationship_id = 'Maps to'").select(F.col("concept_id_1").alias("source"), F.col("concept_id_2").alias("target")).distinct()
    found = search(E.enriched_edges(t), ends.withColumn("pair_id", F.concat_ws(">", "source", "target")), rule=E.EdgeFilter(within_domain=False), max_depth=PAIR_DEPTH, max_paths=MAX_PATHS)
    return found.select("pair_id", F.col("path_no").cast("long").alias("path_no"), path_text(F.col("steps")).alias("steps"))


def path_profile(spark, sf_dir):
    t, found = _upward_shared(spark, sf_dir)
    return profile(t, found.paths()).select("pair_id", path_text(F.col("steps")).alias("steps"), *COUNTERS)


def path_rank(spark, sf_dir):
    t, found = _upward_shared(spark, sf_dir)
    return rank_paths(profile(t, found.paths())).select("pair_id", path_text(F.col("steps")).alias("steps"), F.col("rank_no").cast("long").alias("rank_no"))


def path_explain(spark, sf_dir):
    t, found = _upward_shared(spark, sf_dir)
    return explain(t, found.paths()).select("pair_id", F.col("path_no").cast("long").alias("path_no"), F.col("step_no").cast("long").alias("step_no"), "subject", "predicate", "object", "kind", "reason")


def path_explain_depth(spark, sf_dir):
    """How many steps the search from the source explains, by depth; it depends on how the two searches share the work."""
    t, found = _upward_shared(spark, sf_dir)
    return explain(t, found.paths(), turns=found.turns()).groupBy(F.col("traversal_depth").cast("long").alias("traversal_depth")).agg(F.count(F.lit(1)).alias("n_steps"))


def ranked_paths(spark, sf_dir):
    """Find, rank and explain, both hierarchy directions and mappings, from the target of every 'Maps to' row back to its source."""
    t = _tables(spark, sf_dir)
    ends = t.concept_relationship.where("relationship_id = 'Maps to' AND concept_id_1 <> concept_id_2").select(F.col("concept_id_2").alias("source"), F.col("concept_id_1").alias("target")).distinct()
    rule = E.EdgeFilter(kinds=(ONTOLOGICAL, MAPPING), within_domain=False)
    ranked, _, _ = ranked_paths_with_explanations(t, E.enriched_edges(t), ends.withColumn("pair_id", F.concat_ws(">", "source", "target")), rule=rule, max_depth=PAIR_DEPTH)
    return ranked.select("pair_id", F.col("rank_no").cast("long").alias("rank_no"), path_text(F.col("steps")).alias("steps"), *COUNTERS)


# reasoning
def _pipeline() -> ResolverPipeline:
    return ResolverPipeline([ExactLabelResolver(), ExactSynonymResolver(), PartialLabelResolver()], ResolverConfidence.EXACT)


def _hits(df: DataFrame) -> DataFrame:
    return df.withColumn("hit_no", F.col("hit_no").cast("long"))


def resolve_exact(spark, sf_dir):
    return _hits(ExactLabelResolver().resolve(_tables(spark, sf_dir), _entries(spark, sf_dir)))


def resolve_partial_topk(spark, sf_dir):
    return _hits(PartialLabelResolver().resolve(_tables(spark, sf_dir), _first_words(spark, sf_dir), limit=TOP))


def resolve_pipeline(spark, sf_dir):
    return _hits(_pipeline().resolve(_tables(spark, sf_dir), _entries(spark, sf_dir)))


def _ground(spark, sf_dir, terms: DataFrame, pipeline: ResolverPipeline, **constraints) -> DataFrame:
    scratch = Scratch(spark, "ground")
    t = _tables(spark, sf_dir).cut(scratch, "concept")
    tops = tuple(sorted(r[0] for r in t.concept.where("vocabulary_id = 'CORE'").select("concept_id").limit(MAX_PARENTS + 1).collect()))
    if len(tops) > MAX_PARENTS:
        raise ValueError("too many top concepts")
    found = ground(t, E.enriched_edges(t), scratch.cut(terms, "terms"), pipeline, GroundingConstraints(tops, max_depth=PAIR_DEPTH, **constraints))
    return found.select("term_id", "concept_id", *COUNTERS, F.col("rank_no").cast("long").alias("rank_no"), F.size("paths").cast("long").alias("n_paths"))


def _name_terms(spark, sf_dir) -> DataFrame:
    """Every concept name as a term, lowered; the term is its own id."""
    low = F.lower("concept_name")
    return _tables(spark, sf_dir).concept.select(low.alias("term_id"), low.alias("text")).dropna().distinct()


def ground_terms(spark, sf_dir):
    """Every synonym as a term, resolved by the whole pipeline, grounded below the top concepts over all ontological links."""
    low = F.lower("concept_synonym_name")
    terms = _tables(spark, sf_dir).concept_synonym.select(low.alias("term_id"), low.alias("text")).distinct()
    return _ground(spark, sf_dir, terms, _pipeline())


def ground_terms_upward(spark, sf_dir):
    """Every concept name, upward links only."""
    return _ground(spark, sf_dir, _name_terms(spark, sf_dir), ResolverPipeline([ExactLabelResolver()]), upward_only=True)


def ground_terms_constrained(spark, sf_dir):
    """Every concept name, with constraints of domain, vocabulary and standard flag."""
    return _ground(spark, sf_dir, _name_terms(spark, sf_dir), ResolverPipeline([ExactLabelResolver()]), allowed_domains=frozenset(GROUND_DOMAINS), allowed_vocabularies=frozenset(GROUND_VOCABULARIES), require_standard=True)


def standardise_ids(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return P.standardise_ids(E.enriched_edges(t), _all_ids(t))


def parent_search(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return P.parent_search(E.enriched_edges(t), _all_ids(t))


def subsumes_closure(spark, sf_dir):
    """Everything below each root of the ancestor table."""
    t = _tables(spark, sf_dir)
    return P.subsumes_closure(E.enriched_edges(t), H.roots(t).select(F.lit(0).alias("group_id"), F.col("concept_id").alias("root"))).select("root", "node")


def _groups(t: VocabularyTables) -> DataFrame:
    """The leaves, grouped by domain and class."""
    return H.leaves(t).join(t.concept.select("concept_id", F.concat_ws("/", "domain_id", "concept_class_id").alias("group_id")), "concept_id").select("group_id", "concept_id")


def _common(spark, sf_dir) -> tuple[VocabularyTables, P.CommonParents]:
    t = _tables(spark, sf_dir)
    return t, P.common_parents(E.enriched_edges(t), _groups(t))


def common_parents(spark, sf_dir):
    stats = _common(spark, sf_dir)[1].stats
    return stats.select("group_id", "parent_id", "coverage", "pollution", F.round("purity", 6).alias("purity"), F.round("completeness", 6).alias("completeness"), F.col("max_depth").cast("long").alias("max_depth"))


def relate_groups(spark, sf_dir):
    return P.relate_groups(_common(spark, sf_dir)[1])


def greedy_cover_first(spark, sf_dir):
    t, found = _common(spark, sf_dir)
    return P.greedy_cover(_groups(t), found, max_picks=1).select("group_id", "parent_id", "gain", F.round("score", 6).alias("score"))


def greedy_cover(spark, sf_dir):
    t, found = _common(spark, sf_dir)
    picks = P.greedy_cover(_groups(t), found)
    return picks.select("group_id", F.col("pick_no").cast("long").alias("pick_no"), "parent_id", "gain", F.round("score", 6).alias("score"))


# rendering
def render_path_text(spark, sf_dir):
    t, found = _upward_shared(spark, sf_dir, max_paths=1)
    return R.path_text(t, found.paths()).select("pair_id", "rendered")


def render_path_mermaid(spark, sf_dir):
    t, found = _upward_shared(spark, sf_dir, max_paths=1)
    return R.path_mermaid(t, found.paths()).select("pair_id", "rendered")


def render_subgraph_text(spark, sf_dir):
    t, found = _traverse(spark, sf_dir)
    return R.subgraph_text(t, found.nodes, found.edges)


def render_subgraph_mermaid(spark, sf_dir):
    t, found = _traverse(spark, sf_dir)
    return R.subgraph_mermaid(t, found.nodes, found.edges)


def render_trace_text(spark, sf_dir):
    t, found = _traverse(spark, sf_dir, max_nodes=MAX_NODES)
    return R.trace_text(t, found.trace, found.summary)


QUERIES = {
    f.__name__: f
    for f in (
        concept_view_batch, concept_by_code, concept_synonyms, predicate_row, predicate_kind, predicate_reverse, edges_out, edges_in, edges_batch, edges_active_on_date, edges_by_kind, edges_same_domain, edges_cross_domain, edges_in_filtered, edges_of_predicate, standard_concepts, leaves_vocabulary, parents, children, ancestors, roots, roots_domain, leaves, singletons,
        label_exact, label_fuzzy, synonym_exact, synonym_fuzzy, label_wildcards, label_wildcards_escaped, label_ids_raw, label_rank, traverse_nodes, traverse_edges, traverse_on_date, traverse_max_nodes, traverse_trace, shortest_path_length, shortest_paths, shortest_paths_capped, shortest_paths_parallel, path_profile, path_rank, path_explain, path_explain_depth, ranked_paths,
        resolve_exact, resolve_partial_topk, resolve_pipeline, ground_terms, ground_terms_upward, ground_terms_constrained, standardise_ids, parent_search, subsumes_closure, common_parents, relate_groups, greedy_cover_first, greedy_cover, render_path_text, render_path_mermaid, render_subgraph_text, render_subgraph_mermaid, render_trace_text,
    )
}
