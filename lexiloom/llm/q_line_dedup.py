"""op6: every document without the lines that ten documents share."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.llm.common import table
from lexiloom.llm.line_dedup import line_dedup


def op6_line_dedup(spark, sf_dir):
    left = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op6_line_dedup": op6_line_dedup}

#: Needs a table d (doc_id, text, ...); leaves deduped (d's other columns, text, n_lines, n_dropped).
LINES_CTES = r"""
dr AS (
    SELECT row_number() OVER () AS r, * FROM d
), ln AS (
    SELECT r, i, ls[i] AS line, translate(regexp_replace(regexp_replace(ls[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT r, string_split(coalesce(text, ''), chr(10)) AS ls FROM dr))
), often AS (
    SELECT k FROM ln WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10
), lefts AS (
    SELECT r, count(*) AS n_lines, count(*) FILTER (often.k IS NOT NULL) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (often.k IS NULL), '') AS kept_text
    FROM ln LEFT JOIN often ON ln.k = often.k GROUP BY r
), deduped AS (
    SELECT dr.* EXCLUDE (r, text), kept_text AS text, n_lines, n_dropped FROM dr JOIN lefts USING (r)
)
"""

ORACLE_SQL = {
    "op6_line_dedup": f"""WITH d AS (SELECT doc_id, text FROM documents), {LINES_CTES}
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM deduped"""
}
