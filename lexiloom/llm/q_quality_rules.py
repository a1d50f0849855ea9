"""op2: every document with its measurements and the verdict of policy v1."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.llm import quality_rules as Q
from lexiloom.llm.common import table


def op2_quality_rules(spark, sf_dir):
    rows = Q.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = Q.apply_policy(Q.apply_policy(rows, Q.BASE, "base_ok"), Q.POLICIES["v1"])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_ok")).alias("base_failed"),
        (F.col("base_ok") & F.col("kept")).alias("kept"), "failed_bits",
    )


QUERIES = {"op2_quality_rules": op2_quality_rules}

#: {table} stands for the table read.
LEDGER_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, * FROM {table}
), w AS (
    SELECT r, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM d
), g AS (
    SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
    FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1
), steps AS (
    SELECT r, least(3, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 3)) AS step FROM twice
), rep AS (
    SELECT r, sum(step) AS n FROM steps GROUP BY r
), m AS (
    SELECT d.* EXCLUDE (r), len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
           len(list_filter(regexp_extract_all(t, '[\pL\pN\pM_]+'), lambda x: regexp_full_match(x, '\p{Lu}{2,}')))::BIGINT AS n_caps_words,
           len(regexp_extract_all(t, '!'))::BIGINT AS n_exclaims
    FROM w JOIN d USING (r) LEFT JOIN rep USING (r)
), l AS (
    SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
        + CASE WHEN 10 * n_caps_words > 3 * n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_exclaims > 3 * n_words THEN 32 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed_bits
    FROM m
)
"""

ORACLE_SQL = {
    "op2_quality_rules": LEDGER_SQL.replace("{table}", "documents")
    + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & 3 <> 0 AS base_failed, failed_bits & 127 = 0 AS kept, failed_bits
FROM l
"""
}
