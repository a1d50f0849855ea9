"""op8: what the mix takes of every document."""

from __future__ import annotations

from lexiloom.llm.common import table
from lexiloom.llm.mixing import N_BLOCKS, mix_sizes

SEED = 7


def op8_mixing(spark, sf_dir):
    return mix_sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), SEED).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op8_mixing": op8_mixing}

#: Needs a table d (doc_id, source, text); leaves mixed (d's columns, size, source_size, target, taken).
MIX_CTES = rf"""
sized AS (
    SELECT *, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
           md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h
    FROM d
), s0 AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), s1 AS (
    SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS src FROM s0
), s2 AS (
    SELECT *, (src - 1) % 3 + 1 AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s1
), s3 AS (
    SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
    FROM s2
), s4 AS (
    SELECT *, first_value(CASE WHEN cap >= weight * level THEN level END IGNORE NULLS)
              OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_level
    FROM s3
), s AS (
    SELECT source, src, source_size, cap, total, coalesce(weight * first_level, cap::DOUBLE) AS target,
           greatest(ceil(total / {N_BLOCKS}), 1)::BIGINT AS block
    FROM s4
), q AS (
    SELECT src, block, total, target, unnest(range(0, ceil(2 * target / block)::BIGINT + 2)) AS q FROM s WHERE target > 0
), won AS (
    SELECT src, count(*) AS won FROM (
        SELECT src, row_number() OVER (ORDER BY target / (2 * q + 1) DESC, src) AS place, ceil(total / block) AS seats FROM q
    ) WHERE place <= seats GROUP BY src
), lines AS (
    SELECT s.*, least(coalesce(won, 0) * block, ceil(target), cap)::BIGINT AS words FROM s LEFT JOIN won USING (src) WHERE source_size > 0
), lines2 AS (
    SELECT *, words // source_size AS passes, words % source_size AS rest FROM lines
), b0 AS (
    SELECT *, unnest(range(0, (source_size - 1) // block + 1)) AS b FROM lines2
), b1 AS (
    SELECT *, least(block, source_size - b * block) AS length FROM b0
), b2 AS (
    SELECT *, greatest(least(length, rest - coalesce(sum(length) OVER (PARTITION BY src ORDER BY md5('{SEED}:' || src || ':' || b), b
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS take
    FROM b1
), blocks AS (
    SELECT *, coalesce(sum(take) OVER (PARTITION BY src ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b2
), placed AS (
    SELECT sized.*, s.src, s.source_size, s.target, s.block,
           sum(size) OVER (PARTITION BY s.src ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS stop
    FROM sized JOIN s ON sized.source IS NOT DISTINCT FROM s.source
), mixed AS (
    SELECT placed.* EXCLUDE (src, block, stop, h),
           (CASE WHEN size > 0 THEN x.passes * size + (y.before + least(y.take, stop - y.b * placed.block))
                 - (x.before + least(x.take, stop - size - x.b * placed.block)) ELSE 0 END)::BIGINT AS taken
    FROM placed LEFT JOIN blocks x ON x.src = placed.src AND x.b = (stop - size) // placed.block
                LEFT JOIN blocks y ON y.src = placed.src AND y.b = greatest(stop - 1, 0) // placed.block
)
"""

ORACLE_SQL = {"op8_mixing": f"WITH d AS (SELECT doc_id, source, text FROM documents), {MIX_CTES} SELECT doc_id, size, source_size, target, taken FROM mixed"}
