"""SQL of the queries that SQL can express; the others are tested against brute force in tests/llm."""

ORACLE = {
    "p3_found": """
    WITH RECURSIVE ties AS (
      SELECT concept_id_1 AS a, concept_id_2 AS b FROM concept_relationship
      WHERE relationship_id IN ('Maps to', 'Mapped from', 'Same as', 'Replaced by', 'Replaces') AND invalid_reason IS NULL AND concept_id_1 <> concept_id_2
        AND concept_id_1 IN (SELECT concept_id FROM concept) AND concept_id_2 IN (SELECT concept_id FROM concept)),
    ways AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties),
    reach(v, w) AS (SELECT a, b FROM ways UNION SELECT r.v, t.b FROM reach r JOIN ways t ON t.a = r.w)
    SELECT least(v, min(w)) AS group_id, v AS concept_id FROM reach GROUP BY v""",
}
