"""op1: links and components of all vectors at a cosine of 0.98 within labels."""

from __future__ import annotations

from lexiloom.llm.common import table
from lexiloom.llm.vector_dedup import near_vectors


def op1_vector_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


QUERIES = {"op1_vector_dedup": op1_vector_dedup}

ORACLE_SQL = {
    "op1_vector_dedup": """
WITH RECURSIVE e AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), ok AS (
    SELECT * FROM e WHERE label IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), links AS (
    SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND len(p.x) = len(q.x) AND p.vec_id <> q.vec_id
    WHERE list_cosine_similarity(p.x, q.x) >= 0.98
), reach AS (
    SELECT vec_id AS v, vec_id AS c FROM e UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.v
), comp AS (
    SELECT v, min(c) AS c FROM reach GROUP BY v
), n AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT comp.v AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, comp.c AS component_id, comp.v = comp.c AS kept, 1.0::DOUBLE AS recall FROM comp LEFT JOIN n ON n.a = comp.v
"""
}
