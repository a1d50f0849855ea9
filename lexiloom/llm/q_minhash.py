"""op10: near-duplicate groups of all documents at a similarity of 0.85."""

from __future__ import annotations

from lexiloom.llm.common import table
from lexiloom.llm.minhash import near_duplicates


def op10_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op10_minhash": op10_minhash}

#: Pairs that share a shingle, counted: exact, and fine at the size of the SQL check.
COMPONENT_CTES = r"""
w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM d
), sh AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), links AS (
    SELECT p.a, p.b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
    ) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
    WHERE 100 * p.both >= 85 * (na.n + nb.n - p.both)
), reach AS (
    SELECT doc_id AS v, doc_id AS c FROM w
    UNION
    SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.v
), comp AS (
    SELECT v AS doc_id, min(c) AS component_id FROM reach GROUP BY v
)
"""

ORACLE_SQL = {
    "op10_minhash": f"""WITH RECURSIVE d AS (SELECT doc_id, text FROM documents), {COMPONENT_CTES}
SELECT comp.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = comp.doc_id AS kept
FROM comp LEFT JOIN n USING (doc_id)"""
}
