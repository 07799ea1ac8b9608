"""SQL of the graph queries, written from the semantics and independent of the DataFrame plans."""

from __future__ import annotations

from .graph_queries import DEPTH, DOMAIN, GROUND_DOMAINS, GROUND_VOCABULARIES, MAX_NODES, MAX_PATHS, ON, PAIR_DEPTH, TOP, VOCABULARY, WILD

_CONCEPT = "concept_id, concept_name, concept_code, vocabulary_id, domain_id, concept_class_id, standard_concept, valid_start_date, valid_end_date, invalid_reason"


def _last(columns: list[str]) -> str:
    return ", ".join(f"{c} DESC NULLS LAST" for c in ["loaded_at", *columns])


_C = f"""
c AS (SELECT {_CONCEPT} FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY {_last(_CONCEPT.split(", ")[1:])}) AS rn FROM concept WHERE concept_id IS NOT NULL) WHERE rn = 1)"""
_R = f"""
r AS (SELECT concept_id_1 AS s, relationship_id AS p, concept_id_2 AS o, valid_start_date AS d1, valid_end_date AS d2, invalid_reason AS inv FROM (
  SELECT *, row_number() OVER (PARTITION BY concept_id_1, relationship_id, concept_id_2 ORDER BY {_last(["valid_start_date", "valid_end_date", "invalid_reason"])}) AS rn FROM concept_relationship
  WHERE concept_id_1 IS NOT NULL AND concept_id_2 IS NOT NULL AND relationship_id IS NOT NULL) WHERE rn = 1)"""
_K = """
k AS (SELECT relationship_id AS p, relationship_name AS name, reverse_relationship_id AS rev, coalesce(is_hierarchical, false) AS h, coalesce(defines_ancestry, false) AS a,
  CASE WHEN coalesce(is_hierarchical, false) OR coalesce(defines_ancestry, false) THEN 'ONTOLOGICAL'
    WHEN lower(relationship_name) LIKE '%maps to%' OR lower(relationship_name) LIKE '%mapped from%' OR lower(relationship_name) LIKE '%equivalent%' THEN 'MAPPING'
    WHEN lower(relationship_name) LIKE '%replaced%' OR lower(relationship_name) LIKE '%replaces%' THEN 'VERSIONING'
    WHEN lower(relationship_name) LIKE 'has %' THEN 'ATTRIBUTE' ELSE 'METADATA' END AS kind FROM relationship)"""
_REASON = """CASE kind WHEN 'ONTOLOGICAL' THEN 'ontological relationship (preferred structure)' WHEN 'MAPPING' THEN 'mapping relationship (cross-vocabulary)' WHEN 'ATTRIBUTE' THEN 'attribute enrichment'
  WHEN 'VERSIONING' THEN 'versioning relationship' ELSE 'metadata relationship (low semantic value)' END"""
_E = """
e AS (SELECT r.*, k.kind, cs.domain_id AS sd, co.domain_id AS od, cs.concept_id IS NULL OR co.concept_id IS NULL OR k.p IS NULL AS dangling
  FROM r LEFT JOIN k ON k.p = r.p LEFT JOIN c cs ON cs.concept_id = r.s LEFT JOIN c co ON co.concept_id = r.o),
same AS (SELECT * FROM e WHERE inv IS NULL AND NOT dangling AND sd IS NOT DISTINCT FROM od)"""
_A = """
anc AS (SELECT ancestor_concept_id AS a, descendant_concept_id AS d, min(min_levels_of_separation) AS lvl FROM concept_ancestor WHERE ancestor_concept_id IS NOT NULL AND descendant_concept_id IS NOT NULL GROUP BY ALL),
std AS (SELECT concept_id, domain_id FROM c WHERE standard_concept IS NOT NULL),
rts AS (SELECT * FROM std WHERE NOT EXISTS (SELECT 1 FROM anc WHERE d = std.concept_id AND lvl = 1)),
lvs AS (SELECT * FROM std WHERE NOT EXISTS (SELECT 1 FROM anc WHERE a = std.concept_id AND lvl = 1))"""
_S = """
syn AS (SELECT DISTINCT concept_id, concept_synonym_name AS name FROM concept_synonym WHERE concept_id IS NOT NULL AND concept_synonym_name IS NOT NULL),
flags AS (SELECT concept_id, concept_name, coalesce(standard_concept IN ('S', 'C'), false) AS is_standard, NOT coalesce(invalid_reason IN ('D', 'U'), false) AS is_active FROM c),
names AS (SELECT concept_id, concept_name AS label, is_standard, is_active, 'DIRECT' AS kind FROM flags WHERE concept_name IS NOT NULL),
syns AS (SELECT f.concept_id, s.name AS label, f.is_standard, f.is_active, 'SYNONYM' AS kind FROM syn s JOIN flags f ON f.concept_id = s.concept_id),
entries AS (SELECT canonical_id AS term_id, canonical_name AS text, trim(regexp_replace(lower(canonical_name), '\\s+', ' ', 'g')) AS norm FROM canonical_name),
first AS (SELECT DISTINCT split_part(canonical_name, ' ', 1) AS text, lower(split_part(canonical_name, ' ', 1)) AS norm FROM canonical_name)"""

_ALL = f"WITH RECURSIVE {_C}, {_R}, {_K}, {_E}, {_A}, {_S}"
_EDGE = "s AS subject_id, p AS predicate_id, o AS object_id, kind, CAST(d1 AS VARCHAR) AS valid_start_date, CAST(d2 AS VARCHAR) AS valid_end_date, inv AS invalid_reason"
_ON = f"(d1 IS NULL OR d1 <= DATE '{ON}') AND (d2 IS NULL OR d2 >= DATE '{ON}')"
_FROM = "s IN (SELECT concept_id FROM c)"


def _edge_query(where: str) -> str:
    return f"{_ALL} SELECT {_EDGE} FROM e WHERE {where}"


def _walk(extra: str = "") -> str:
    """nodes(q, node, depth) within DEPTH of the roots of each domain."""
    return f"""{_ALL}, ont AS (SELECT DISTINCT s, p, o FROM same WHERE kind = 'ONTOLOGICAL' {extra}),
    go(q, node, depth) AS (SELECT domain_id, concept_id, 0 FROM rts WHERE domain_id IS NOT NULL UNION SELECT go.q, ont.o, go.depth + 1 FROM go JOIN ont ON ont.s = go.node WHERE go.depth < {DEPTH}),
    nodes AS (SELECT q, node, min(depth) AS depth FROM go GROUP BY q, node)"""


#: longest chain of links the recursions follow; the tables' hierarchies are about half as deep
_HIGH = 60


def _search(links: str, pairs: str, cap: int = MAX_PATHS, before: str = "") -> str:
    """found(pair_id, src, tgt, steps, path_no): all shortest paths over ``links`` (s, p, o) for ``pairs`` (src, tgt), the first ``cap`` of each."""
    return f"""{_ALL}{before}, lk AS (SELECT DISTINCT s, p, o FROM {links}), hop AS (SELECT DISTINCT s, o FROM lk), pairs AS ({pairs}),
    fwd(src, node, k) AS (SELECT DISTINCT src, src, 0 FROM pairs UNION SELECT f.src, i.o, f.k + 1 FROM fwd f JOIN hop i ON i.s = f.node WHERE f.k < {PAIR_DEPTH}),
    dist AS (SELECT src, node, min(k) AS k FROM fwd GROUP BY src, node),
    len AS (SELECT p.src, p.tgt, d.k AS n FROM pairs p LEFT JOIN dist d ON d.src = p.src AND d.node = p.tgt),
    walks(src, tgt, node, k, steps, sort_key) AS (
      SELECT src, tgt, tgt, n, CAST('' AS VARCHAR), CAST([] AS VARCHAR[]) FROM len WHERE n IS NOT NULL
      UNION ALL SELECT w.src, w.tgt, i.s, w.k - 1, concat(i.s, '|', i.p, '|', i.o, CASE WHEN w.steps = '' THEN '' ELSE '; ' END, w.steps), list_prepend(concat(lpad(CAST(i.s AS VARCHAR), 12, '0'), i.p, lpad(CAST(i.o AS VARCHAR), 12, '0')), w.sort_key)
      FROM walks w JOIN lk i ON i.o = w.node JOIN dist d ON d.src = w.src AND d.node = i.s AND d.k = w.k - 1),
    numbered AS (SELECT concat(src, '>', tgt) AS pair_id, src, tgt, steps, sort_key, row_number() OVER (PARTITION BY src, tgt ORDER BY sort_key) AS path_no FROM walks WHERE k = 0),
    found AS (SELECT * FROM numbered WHERE path_no <= {cap})"""


_SEARCH = _search("e WHERE inv IS NULL AND kind = 'ONTOLOGICAL'", "SELECT d AS src, a AS tgt FROM anc")

_STEPS = """, steps AS (SELECT pair_id, path_no, src, unnest(string_split(steps, '; ')) AS step, generate_subscripts(string_split(steps, '; '), 1) AS no FROM found WHERE steps <> ''),
parts AS (SELECT pair_id, path_no, no, CAST(split_part(step, '|', 1) AS BIGINT) AS s, split_part(step, '|', 2) AS p, CAST(split_part(step, '|', 3) AS BIGINT) AS o FROM steps)"""

_COUNTERS = "invalid_concepts, non_standard_concepts, metadata_edges, mapping_edges, vocabulary_switches, hops, ontological_edges"
_ZERO = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in _COUNTERS.split(", "))

_PROFILE = f"""{_STEPS},
nod AS (SELECT pair_id, path_no, 0 AS pos, s AS node FROM parts WHERE no = 1 UNION ALL SELECT pair_id, path_no, no, o FROM parts),
seen AS (SELECT n.*, c.concept_id IS NOT NULL AS known, c.vocabulary_id AS v, c.standard_concept AS sc, c.invalid_reason AS inv, lag(c.vocabulary_id) OVER (PARTITION BY pair_id, path_no ORDER BY pos) AS pv FROM nod n LEFT JOIN c ON c.concept_id = n.node),
by_node AS (SELECT pair_id, path_no, sum(CASE WHEN coalesce(inv, '') <> '' THEN 1 ELSE 0 END) AS invalid_concepts, sum(CASE WHEN known AND sc IS NULL THEN 1 ELSE 0 END) AS non_standard_concepts,
  sum(CASE WHEN coalesce(pv, '') <> '' AND pv IS DISTINCT FROM v THEN 1 ELSE 0 END) AS vocabulary_switches FROM seen GROUP BY ALL),
by_step AS (SELECT pair_id, path_no, count(*) AS hops, sum(CASE WHEN kind = 'ONTOLOGICAL' THEN 1 ELSE 0 END) AS ontological_edges, sum(CASE WHEN kind = 'MAPPING' THEN 1 ELSE 0 END) AS mapping_edges,
  sum(CASE WHEN kind IN ('ONTOLOGICAL', 'MAPPING') THEN 0 ELSE 1 END) AS metadata_edges FROM parts LEFT JOIN k ON k.p = parts.p GROUP BY ALL),
prof AS (SELECT f.pair_id, f.src, f.tgt, f.path_no, f.steps, {_ZERO} FROM found f LEFT JOIN by_node USING (pair_id, path_no) LEFT JOIN by_step USING (pair_id, path_no))"""
_RANKED = "row_number() OVER (PARTITION BY pair_id ORDER BY invalid_concepts, non_standard_concepts, metadata_edges, mapping_edges, vocabulary_switches, hops, -ontological_edges, path_no)"

_PARALLEL = _search("e WHERE inv IS NULL", "SELECT DISTINCT s AS src, o AS tgt FROM r WHERE p = 'Maps to'")
_BACK = _search("e WHERE inv IS NULL AND kind IN ('ONTOLOGICAL', 'MAPPING')", "SELECT DISTINCT o AS src, s AS tgt FROM r WHERE p = 'Maps to' AND s <> o")

_SIMILAR = "ORDER BY CASE WHEN starts_with(lower(label), lower(text)) THEN 0 ELSE 1 END, length(label) - length(replace(label, ' ', '')), abs(length(label) - length(text)), concept_id"
_PARTIAL = "row_number() OVER (PARTITION BY text {order}) AS hit_no".format(order=_SIMILAR)

_GROUPS = f"""{_ALL}, isa AS (SELECT DISTINCT s, o FROM same WHERE p = 'Is a' AND s <> o), down AS (SELECT DISTINCT s, o FROM same WHERE p = 'Subsumes' AND s <> o),
maps AS (SELECT s, min(o) AS o FROM same WHERE p = 'Maps to' GROUP BY s),
seeds AS (SELECT concat_ws('/', c.domain_id, c.concept_class_id) AS g, lvs.concept_id AS id FROM lvs JOIN c USING (concept_id)),
up(g, origin, node, k) AS (SELECT g, id, id, 0 FROM seeds UNION SELECT u.g, u.origin, i.o, u.k + 1 FROM up u JOIN isa i ON i.s = u.node WHERE u.k < {_HIGH}),
first_met AS (SELECT g, origin, node, min(k) AS k FROM up GROUP BY ALL),
facts AS (SELECT g, origin, coalesce(maps.o, i.o) AS parent, max(k + 1) AS k FROM first_met JOIN isa i ON i.s = node LEFT JOIN maps ON maps.s = i.o GROUP BY ALL),
cov AS (SELECT g, parent, count(DISTINCT origin) AS coverage, max(k) AS max_depth FROM facts GROUP BY ALL HAVING count(DISTINCT origin) >= 2),
clo(g, root, node) AS (SELECT cov.g, cov.parent, d.o FROM cov JOIN down d ON d.s = cov.parent UNION SELECT clo.g, clo.root, d.o FROM clo JOIN down d ON d.s = clo.node LEFT JOIN seeds ON seeds.g = clo.g AND seeds.id = clo.node WHERE seeds.id IS NULL),
pol AS (SELECT clo.g, root AS parent, count(*) AS pollution FROM clo LEFT JOIN seeds ON seeds.g = clo.g AND seeds.id = clo.node WHERE seeds.id IS NULL GROUP BY ALL),
sizes AS (SELECT g, count(*) AS n FROM seeds GROUP BY g),
stats AS (SELECT cov.g AS group_id, cov.parent AS parent_id, coverage, coalesce(pollution, 0) AS pollution, coverage * 1.0 / (coverage + coalesce(pollution, 0)) AS purity, coverage * 1.0 / n AS completeness, max_depth
  FROM cov LEFT JOIN pol USING (g, parent) JOIN sizes USING (g))"""
_SCORE = "CAST(coverage AS DOUBLE) * purity / (pow(1 + pollution, 0.3) * pow(1 + max_depth, 0.7))"

_BLANKS = r"[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+"
_SYNONYM_TERMS = f", terms AS (SELECT DISTINCT lower(name) AS term_id, lower(name) AS text, trim(regexp_replace(lower(name), '{_BLANKS}', ' ', 'g')) AS norm FROM syn)"
_PIPELINE = f""", met AS (
      SELECT term_id, concept_id, 0 AS stage, 'exact_label' AS resolver, row_number() OVER (PARTITION BY term_id ORDER BY concept_id, label) AS no FROM terms JOIN names ON lower(label) = norm
      UNION ALL SELECT term_id, concept_id, 1, 'exact_synonym', row_number() OVER (PARTITION BY term_id ORDER BY concept_id, label) FROM terms JOIN syns ON lower(label) = norm
      UNION ALL SELECT term_id, concept_id, 2, 'partial_label', row_number() OVER (PARTITION BY term_id {_SIMILAR}) FROM terms JOIN names ON lower(label) LIKE concat('%', norm, '%')),
      kept AS (SELECT * FROM (SELECT *, min(stage) OVER (PARTITION BY term_id) AS f FROM met) WHERE stage < 2 OR f = 2),
      first_hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term_id, concept_id ORDER BY stage, no) AS rn FROM kept) WHERE rn = 1),
      piped AS (SELECT term_id, concept_id, resolver, row_number() OVER (PARTITION BY term_id ORDER BY stage, no, concept_id) AS hit_no FROM first_hit)"""
#: every concept name that equals itself when normalised
_NAMED = f""", piped AS (SELECT lower(concept_name) AS term_id, concept_id, concept_id AS hit_no FROM c
      WHERE concept_name IS NOT NULL AND trim(regexp_replace(lower(concept_name), '{_BLANKS}', ' ', 'g')) = lower(concept_name))"""


def _ground(piped: str, links: str, where: str = "true") -> str:
    before = f"""{piped}, tops AS (SELECT concept_id AS top FROM c WHERE vocabulary_id = 'CORE'), hits AS (SELECT piped.* FROM piped JOIN c USING (concept_id) WHERE {where})"""
    order = _COUNTERS.replace("ontological_edges", "-ontological_edges")
    return f"""{_search(links, "SELECT DISTINCT concept_id AS src, top AS tgt FROM hits, tops", 3, before)} {_PROFILE},
      best AS (SELECT *, count(*) OVER (PARTITION BY src) AS n_paths, row_number() OVER (PARTITION BY src ORDER BY {order}, tgt, path_no) AS rn FROM prof)
      SELECT h.term_id, h.concept_id, {_COUNTERS}, row_number() OVER (PARTITION BY h.term_id ORDER BY {order}, h.hit_no) AS rank_no, n_paths
      FROM hits h JOIN best ON best.src = h.concept_id AND rn = 1"""


_WILD = "wild AS (SELECT unnest([{}]) AS text)".format(", ".join(f"'{w}'" for w in WILD))

ORACLE = {
    "concept_view_batch": f"{_ALL} SELECT concept_id, concept_name, concept_code, vocabulary_id, domain_id, concept_class_id, standard_concept, CAST(valid_start_date AS VARCHAR) AS valid_start_date, CAST(valid_end_date AS VARCHAR) AS valid_end_date, invalid_reason FROM c WHERE concept_id IN (SELECT s FROM r)",
    "concept_by_code": f"{_ALL} SELECT vocabulary_id, concept_code, concept_id FROM c WHERE vocabulary_id IS NOT NULL AND concept_code IS NOT NULL",
    "concept_synonyms": f"{_ALL} SELECT concept_id, name AS concept_synonym_name FROM syn WHERE concept_id IN (SELECT concept_id FROM c)",
    "predicate_row": f"{_ALL} SELECT p AS predicate_id, name, rev AS reverse_id, h AS is_hierarchical, a AS defines_ancestry FROM k",
    "predicate_kind": f"{_ALL} SELECT p AS predicate_id, kind, {_REASON} AS reason FROM k",
    "predicate_reverse": f"{_ALL} SELECT x.p AS predicate_id, x.rev AS reverse_id, y.name AS reverse_name FROM k x LEFT JOIN k y ON y.p = x.rev",
    "edges_out": _edge_query(_FROM),
    "edges_in": _edge_query("o IN (SELECT concept_id FROM c)"),
    "edges_batch": _edge_query(f"{_FROM} AND p = 'Maps to'"),
    "edges_active_on_date": _edge_query(f"{_FROM} AND inv IS NULL AND {_ON}"),
    "edges_by_kind": _edge_query(f"{_FROM} AND inv IS NULL AND kind IN ('ONTOLOGICAL', 'MAPPING')"),
    "edges_same_domain": f"{_ALL} SELECT {_EDGE} FROM same",
    "edges_cross_domain": _edge_query("inv IS NULL AND NOT dangling AND sd IS DISTINCT FROM od"),
    "edges_in_filtered": _edge_query(f"o IN (SELECT concept_id FROM c) AND inv IS NULL AND {_ON} AND NOT dangling AND sd IS NOT DISTINCT FROM od AND kind IN ('ONTOLOGICAL', 'ATTRIBUTE')"),
    "edges_of_predicate": _edge_query("o IN (SELECT concept_id FROM c) AND inv IS NULL AND p = 'Subsumes'"),
    "standard_concepts": f"{_ALL} SELECT concept_id FROM c WHERE standard_concept IS NOT NULL AND vocabulary_id = '{VOCABULARY}' AND domain_id = '{DOMAIN}'",
    "leaves_vocabulary": f"{_ALL} SELECT concept_id FROM lvs JOIN c USING (concept_id) WHERE vocabulary_id = '{VOCABULARY}'",
    "parents": f"{_ALL} SELECT d AS concept_id, a AS relative_id FROM anc WHERE lvl = 1 AND d IN (SELECT concept_id FROM c)",
    "children": f"{_ALL} SELECT a AS concept_id, d AS relative_id FROM anc WHERE lvl = 1 AND a IN (SELECT concept_id FROM c)",
    "ancestors": f"{_ALL} SELECT d AS concept_id, a AS relative_id FROM anc WHERE d IN (SELECT concept_id FROM c)",
    "roots": f"{_ALL} SELECT concept_id FROM rts",
    "roots_domain": f"{_ALL} SELECT concept_id FROM rts WHERE domain_id = '{DOMAIN}'",
    "leaves": f"{_ALL} SELECT concept_id FROM lvs",
    "singletons": f"{_ALL} SELECT concept_id FROM rts WHERE concept_id IN (SELECT concept_id FROM lvs)",
    "label_exact": f"{_ALL} SELECT term_id, norm AS input_label, label AS matched_label, concept_id, kind AS match_kind, is_standard, is_active FROM entries JOIN names ON lower(label) = norm WHERE norm <> ''",
    "label_fuzzy": f"{_ALL} SELECT text AS term_id, norm AS input_label, label AS matched_label, concept_id, kind AS match_kind, is_standard, is_active FROM first JOIN names ON lower(label) LIKE concat('%', norm, '%') WHERE norm <> ''",
    "synonym_exact": f"{_ALL} SELECT term_id, norm AS input_label, label AS matched_label, concept_id, kind AS match_kind, is_standard, is_active FROM entries JOIN syns ON lower(label) = norm WHERE norm <> ''",
    "synonym_fuzzy": f"{_ALL} SELECT text AS term_id, norm AS input_label, label AS matched_label, concept_id, kind AS match_kind, is_standard, is_active FROM first JOIN syns ON lower(label) LIKE concat('%', norm, '%') WHERE norm <> ''",
    "label_wildcards": f"{_ALL}, {_WILD} SELECT text AS term_id, text AS input_label, label AS matched_label, concept_id, kind AS match_kind, is_standard, is_active FROM wild JOIN names ON lower(label) LIKE concat('%', text, '%')",
    "label_wildcards_escaped": f"""{_ALL}, {_WILD}, both_ AS (SELECT text, text AS norm FROM wild UNION SELECT text, norm FROM first)
      SELECT text AS term_id, norm AS input_label, label AS matched_label, concept_id, kind AS match_kind, is_standard, is_active FROM both_ JOIN names ON contains(lower(label), norm) WHERE norm <> ''""",
    "label_ids_raw": f"{_ALL} SELECT term_id, concept_id FROM entries JOIN c ON lower(concept_name) = lower(text)",
    "label_rank": f"""{_ALL}, met AS (SELECT term_id, n.* FROM entries JOIN (SELECT * FROM names UNION ALL SELECT * FROM syns) n ON lower(label) = norm)
      SELECT term_id, concept_id, label AS matched_label, kind AS match_kind, row_number() OVER (PARTITION BY term_id ORDER BY NOT is_standard, NOT is_active, kind = 'SYNONYM', concept_id, label) AS rank_no FROM met""",
    "traverse_nodes": f"{_walk()} SELECT q AS query_id, node, CAST(depth AS BIGINT) AS depth, depth < {DEPTH} AS expanded FROM nodes",
    "traverse_edges": f"{_walk()} SELECT q AS query_id, s AS subject_id, p AS predicate_id, o AS object_id FROM nodes JOIN ont ON s = node WHERE depth < {DEPTH}",
    "traverse_on_date": f"{_walk('AND ' + _ON)} SELECT q AS query_id, node, CAST(depth AS BIGINT) AS depth FROM nodes",
    "traverse_max_nodes": f"""{_walk()}, ord AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY depth, node) AS rn, count(*) OVER (PARTITION BY q) AS total FROM nodes)
      SELECT q AS query_id, node, CAST(depth AS BIGINT) AS depth, depth < {DEPTH} AND rn < {MAX_NODES} AS expanded, CASE WHEN total >= {MAX_NODES} THEN 'max_nodes' END AS terminated_reason FROM ord WHERE rn <= {MAX_NODES}""",
    "traverse_trace": f"""{_walk()}, st AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY depth, node) AS step_no FROM nodes WHERE depth < {DEPTH})
      SELECT q AS query_id, step_no, CAST(depth AS BIGINT) AS depth, node, p AS predicate_id, o AS object_id FROM st LEFT JOIN ont ON s = node""",
    "shortest_path_length": f"{_SEARCH} SELECT concat(src, '>', tgt) AS pair_id, CAST(n AS BIGINT) AS hops, CASE WHEN src = tgt THEN 'source_equals_target' WHEN n IS NULL THEN 'no_path' ELSE 'shortest_paths_found' END AS reason FROM len",
    "shortest_paths": f"{_SEARCH} SELECT pair_id, path_no, steps FROM found",
    "shortest_paths_capped": f"{_SEARCH} SELECT pair_id, steps FROM found WHERE path_no = 1",
    "shortest_paths_parallel": f"{_PARALLEL} SELECT pair_id, path_no, steps FROM found",
    "path_profile": f"{_SEARCH} {_PROFILE} SELECT pair_id, steps, {_COUNTERS} FROM prof",
    "path_rank": f"{_SEARCH} {_PROFILE} SELECT pair_id, steps, {_RANKED} AS rank_no FROM prof",
    "path_explain": f"{_SEARCH} {_STEPS} SELECT pair_id, path_no, no AS step_no, parts.s AS subject, parts.p AS predicate, parts.o AS object, kind, {_REASON} AS reason FROM parts LEFT JOIN k ON k.p = parts.p",
    "ranked_paths": f"{_BACK} {_PROFILE} SELECT pair_id, {_RANKED} AS rank_no, steps, {_COUNTERS} FROM prof",
    "resolve_exact": f"{_ALL} SELECT term_id, concept_id, row_number() OVER (PARTITION BY term_id ORDER BY concept_id, label) AS hit_no FROM entries JOIN names ON lower(label) = norm",
    "resolve_partial_topk": f"{_ALL}, met AS (SELECT text AS term_id, concept_id, {_PARTIAL} FROM first JOIN names ON lower(label) LIKE concat('%', norm, '%')) SELECT * FROM met WHERE hit_no <= {TOP}",
    "resolve_pipeline": f"{_ALL}, terms AS (SELECT * FROM entries){_PIPELINE} SELECT term_id, concept_id, resolver, hit_no FROM piped",
    "ground_terms": _ground(_SYNONYM_TERMS + _PIPELINE, "same WHERE kind = 'ONTOLOGICAL'"),
    "ground_terms_upward": _ground(_NAMED, "same WHERE p = 'Is a'"),
    "ground_terms_constrained": _ground(_NAMED, "same WHERE kind = 'ONTOLOGICAL'", f"c.domain_id IN {GROUND_DOMAINS} AND c.vocabulary_id IN {GROUND_VOCABULARIES} AND c.standard_concept IS NOT NULL"),
    "standardise_ids": f"{_ALL} SELECT c.concept_id, coalesce(m.o, c.concept_id) AS standard_id FROM c LEFT JOIN (SELECT s, min(o) AS o FROM same WHERE p = 'Maps to' GROUP BY s) m ON m.s = c.concept_id",
    "parent_search": f"{_ALL} SELECT DISTINCT s AS concept_id, o AS parent_id FROM same WHERE p = 'Is a' AND s <> o",
    "subsumes_closure": f"{_ALL}, down AS (SELECT DISTINCT s, o FROM same WHERE p = 'Subsumes' AND s <> o), clo(root, node) AS (SELECT concept_id, o FROM rts JOIN down ON s = concept_id UNION SELECT clo.root, d.o FROM clo JOIN down d ON d.s = clo.node) SELECT root, node FROM clo",
    "common_parents": f"{_GROUPS} SELECT group_id, parent_id, coverage, pollution, round(purity, 6) AS purity, round(completeness, 6) AS completeness, CAST(max_depth AS BIGINT) AS max_depth FROM stats",
    "relate_groups": f"""{_GROUPS}, own AS (SELECT f.g, f.parent, f.origin FROM facts f JOIN cov USING (g, parent) GROUP BY ALL),
      both_ AS (SELECT x.g, x.parent AS a, y.parent AS b, count(*) AS n FROM own x JOIN own y ON x.g = y.g AND x.origin = y.origin AND x.parent <> y.parent GROUP BY ALL)
      SELECT both_.g AS group_id, a AS from_id, b AS to_id, 'subsumed_by' AS type, n AS overlap FROM both_ JOIN cov ON cov.g = both_.g AND cov.parent = a WHERE n = coverage""",
    "greedy_cover_first": f"{_GROUPS} SELECT group_id, parent_id, coverage AS gain, round(score, 6) AS score FROM (SELECT *, {_SCORE} AS score, row_number() OVER (PARTITION BY group_id ORDER BY {_SCORE} DESC, parent_id) AS rn FROM stats) WHERE rn = 1",
    "greedy_cover": f"""{_GROUPS}, own AS (SELECT f.g, f.parent, f.origin FROM facts f JOIN cov USING (g, parent) GROUP BY ALL),
      lists AS (SELECT g, parent, list(origin) AS found FROM own GROUP BY ALL),
      pick(g, pick_no, parent, gain, score, remaining) AS (
        SELECT g, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), list(id) FROM seeds GROUP BY g
        UNION ALL SELECT g, pick_no, parent, gain, score, remaining FROM (
          SELECT x.*, row_number() OVER (PARTITION BY g ORDER BY score DESC, parent) AS rn FROM (
            SELECT p.g, p.pick_no + 1 AS pick_no, l.parent, CAST(len(list_intersect(l.found, p.remaining)) AS BIGINT) AS gain,
              len(list_intersect(l.found, p.remaining)) * purity / (pow(1 + pollution, 0.3) * pow(1 + max_depth, 0.7)) AS score, list_filter(p.remaining, lambda x: NOT list_contains(l.found, x)) AS remaining
            FROM pick p JOIN lists l ON l.g = p.g JOIN stats s ON s.group_id = p.g AND s.parent_id = l.parent JOIN sizes n ON n.g = p.g
            WHERE len(p.remaining) > 0) x WHERE gain >= 1) WHERE rn = 1)
      SELECT g AS group_id, pick_no, parent AS parent_id, gain, round(score, 6) AS score FROM pick WHERE pick_no > 0""",
    "render_path_text": f"{_SEARCH} {_STEPS} SELECT pair_id, string_agg(concat(coalesce(x.concept_name, ''), ' --[', parts.p, ']--> ', coalesce(y.concept_name, '')), chr(10) ORDER BY no) AS rendered FROM parts LEFT JOIN c x ON x.concept_id = parts.s LEFT JOIN c y ON y.concept_id = parts.o WHERE path_no = 1 GROUP BY pair_id",
    "render_path_mermaid": f"""{_SEARCH} {_STEPS} SELECT pair_id, concat('graph LR', chr(10), string_agg(concat(parts.s, '["', replace(coalesce(x.concept_name, ''), '"', '#quot;'), '"] -->|', parts.p, '| ', parts.o, '["', replace(coalesce(y.concept_name, ''), '"', '#quot;'), '"]'), chr(10) ORDER BY no)) AS rendered
      FROM parts LEFT JOIN c x ON x.concept_id = parts.s LEFT JOIN c y ON y.concept_id = parts.o WHERE path_no = 1 GROUP BY pair_id""",
    "render_subgraph_text": f"""{_walk()}, lines AS (SELECT q, count(*) AS n, string_agg(concat('- ', coalesce(concept_name, ''), ' (', coalesce(vocabulary_id, ''), ':', coalesce(concept_code, ''), ')'), chr(10) ORDER BY node) AS body FROM nodes LEFT JOIN c ON concept_id = node GROUP BY q),
      es AS (SELECT q, count(*) AS n FROM nodes JOIN ont ON s = node WHERE depth < {DEPTH} GROUP BY q)
      SELECT lines.q AS query_id, concat('Subgraph:', chr(10), '  Nodes: ', lines.n, chr(10), '  Edges: ', coalesce(es.n, 0), chr(10), chr(10), body) AS rendered FROM lines LEFT JOIN es USING (q)""",
    "render_subgraph_mermaid": f"""{_walk()}, es AS (SELECT q, s, p, o, k.name FROM nodes JOIN ont ON s = node JOIN k USING (p) WHERE depth < {DEPTH}),
      lines AS (SELECT q, 0 AS part, node AS a, '' AS p, 0 AS b, concat('  ', node, '["', replace(coalesce(concept_name, ''), '"', '#quot;'), '\\n', coalesce(vocabulary_id, ''), ':', coalesce(concept_code, ''), '"]') AS line FROM nodes LEFT JOIN c ON concept_id = node
        UNION ALL SELECT q, 1, s, p, o, concat('  ', s, ' -->|', coalesce(name, ''), '| ', o) FROM es)
      SELECT q AS query_id, concat('graph TD', chr(10), string_agg(line, chr(10) ORDER BY part, a, p, b)) AS rendered FROM lines GROUP BY q""",
    "render_trace_text": f"""{_walk()}, ord AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY depth, node) AS rn, count(*) OVER (PARTITION BY q) AS total FROM nodes),
      st AS (SELECT q, node, depth, row_number() OVER (PARTITION BY q ORDER BY depth, node) AS no FROM ord WHERE depth < {DEPTH} AND rn < {MAX_NODES}),
      met AS (SELECT q, no, p, o, row_number() OVER (PARTITION BY q, no, p ORDER BY o) AS rn, count(*) OVER (PARTITION BY q, no, p) AS n FROM st JOIN ont ON s = node),
      lines AS (SELECT q, no, '' AS p, 0 AS rn, concat('[depth ', depth, '] ', coalesce(concept_name, '')) AS line FROM st LEFT JOIN c ON concept_id = node
        UNION ALL SELECT q, no, p, 0, concat('    └─ ', coalesce(name, '')) FROM met JOIN k USING (p) WHERE rn = 1
        UNION ALL SELECT q, no, p, rn, concat('        → ', coalesce(concept_name, '')) FROM met LEFT JOIN c ON concept_id = o WHERE rn <= 6
        UNION ALL SELECT q, no, p, 7, concat('        … ', n - 6, ' more') FROM met WHERE rn = 1 AND n > 6
        UNION ALL SELECT DISTINCT q, 2147483647, '', 0, '[terminated: max_nodes]' FROM ord WHERE total >= {MAX_NODES})
      SELECT q AS query_id, string_agg(line, chr(10) ORDER BY no, p, rn) AS rendered FROM lines GROUP BY q""",
}
