"""A stream of patterns against a static collection of texts.

Every micro-batch of patterns is joined with the texts' windows by seed, and the hits with
the chunks that hold them: stream-static joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiloom.operators.windows import CHUNK, SEEDS, chunks, windows


def search_stream(texts: DataFrame, patterns: DataFrame, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """(doc_id, pat_id, pos) for a streaming (pat_id, pattern), patterns of any length but 0.

    Patterns are seeded by classes, as ``exact.matches`` does; ``seeds`` names those in use,
    1 among them.  Hits of at most CHUNK characters are compared with the chunk that holds
    them, longer ones with the text.  Stream-static equi-joins: no state is kept, so nothing
    grows with the stream.
    """
    return _found(texts, patterns, seeds).select("doc_id", "pat_id", "pos")


def _found(texts: DataFrame, patterns: DataFrame, seeds: tuple[int, ...]) -> DataFrame:
    """Occurrences with all columns of the stream."""
    if 1 not in seeds:
        raise ValueError("patterns of one character need a seed of one")
    m, known = F.char_length("pattern"), sorted(seeds)
    hits = None
    for n, q in enumerate(known):
        some = patterns.where((m >= q) & (m < known[n + 1]) if n + 1 < len(known) else m >= q)
        met = some.withColumn("_w", F.substring("pattern", 1, q)).join(windows(texts, q), F.col("_w") == F.col("window")).drop("_w", "window")
        hits = met if hits is None else hits.union(met)
    held = chunks(texts, CHUNK).select(F.col("doc_id").alias("_doc"), F.col("c").alias("_c"), "part")
    short = hits.where(m <= CHUNK).join(held, (F.col("doc_id") == F.col("_doc")) & (F.floor(F.col("pos") / CHUNK) == F.col("_c")))
    short = short.where(F.substring("part", (F.col("pos") - F.col("_c") * CHUNK + 1).cast("int"), m) == F.col("pattern"))
    whole = texts.select(F.col("doc_id").alias("_doc"), "text")
    long = hits.where(m > CHUNK).join(whole, F.col("doc_id") == F.col("_doc"))
    long = long.where(F.substring("text", (F.col("pos") + 1).cast("int"), m) == F.col("pattern"))
    return short.select(*hits.columns).union(long.select(*hits.columns))


def counts_stream(texts: DataFrame, patterns: DataFrame, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """(pat_id, n) so far; the state is a row for each pattern id seen."""
    return search_stream(texts, patterns, seeds).groupBy("pat_id").agg(F.count("*").alias("n"))


def windowed_counts(texts: DataFrame, patterns: DataFrame, at: str, width: str, late: str, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """(window, pat_id, n) by event time; windows are closed ``late`` behind the newest event."""
    timed = patterns.withWatermark(at, late).select("pat_id", "pattern", at)
    return _found(texts, timed, seeds).groupBy(F.window(at, width).alias("window_"), "pat_id").agg(F.count("*").alias("n")).withColumnRenamed("window_", "window")


def start(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends hits to Parquet files, once for each pattern, whatever fails meanwhile."""
    return found.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
