"""All windows of a length, made in linear time.

``substring`` walks a string from its start, so a window a position would be quadratic.
Texts are cut once in pieces by a regular expression, in one pass; a piece and the start of
the next ones make a chunk, and windows are taken within chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256
#: Lengths of the pieces in which stretches are looked up.
SIZES = [CHUNK << (2 * i) for i in range(12)]
#: Seeds of patterns are made in classes that begin at these lengths, so that a short pattern
#: does not shorten the seeds of others; no seed is longer than the last.
SEEDS = (1, 2, 4, 8, 16)
#: As many patterns of ROUGH characters or more are one class: seeds of that length are rare
#: enough in a text for them, and another class would cost another pass.
FEW, ROUGH = 20_000, 4


def spread(texts: DataFrame) -> DataFrame:
    """Texts dealt to all cores where they come in fewer partitions than there are cores.

    A window is made for every position, hundreds of rows from one; texts read from many
    files or row groups stay where they are.
    """
    cores = texts.sparkSession.sparkContext.defaultParallelism
    if texts.isStreaming or texts.rdd.getNumPartitions() >= cores:
        return texts
    return texts.repartition(cores)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def chunks(texts: DataFrame, overlap: int, size: int = CHUNK, dealt: bool = False) -> DataFrame:
    """(doc_id, c, part): piece c of ``size`` characters and up to ``overlap`` more, at most ``size``.

    ``dealt``: the texts have been spread before, and stay where they are.
    """
    if overlap > size:
        raise ValueError("chunks overlap by their own length at most")
    pieces = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % size), 0)
    joined = lambda p: F.transform(p, lambda x, c: F.concat(x, F.substring(F.coalesce(F.get(p, c + 1), F.lit("")), 1, overlap)))
    rows = (texts if dealt else spread(texts)).select("doc_id", F.posexplode(let(pieces, joined) if overlap else pieces).alias("c", "part"))
    return rows.select("doc_id", F.col("c").cast("long").alias("c"), "part")


def _exploded(pieces: DataFrame, q: int, size: int, made) -> DataFrame:
    """(doc_id, pos, w): ``made`` of the place (from 1) of each window of the pieces."""
    last = F.least(F.lit(size), F.char_length("part") - q + 1)
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    rows = pieces.select("doc_id", "c", F.posexplode(F.transform(starts, made)).alias("i", "w"))
    return rows.select("doc_id", (F.col("c") * size + F.col("i")).alias("pos"), "w")


def windows(texts: DataFrame, q: int) -> DataFrame:
    """(doc_id, pos, window): every window of ``q`` characters; pos counts from 0."""
    size = size_for(q)
    return _exploded(chunks(texts, q - 1, size), q, size, lambda i: F.substring("part", i, F.lit(q))).withColumnRenamed("w", "window")


def windows_with_tail(texts: DataFrame, q: int, longest: int) -> DataFrame:
    """(doc_id, pos, window, tail): the window, and up to ``longest`` characters from its start."""
    size = size_for(longest)
    made = lambda i: F.struct(F.substring("part", i, F.lit(q)).alias("window"), F.substring("part", i, F.lit(longest)).alias("tail"))
    return _exploded(chunks(texts, longest - 1, size), q, size, made).select("doc_id", "pos", "w.window", "w.tail")


def windows_within(texts: DataFrame, q: int, before: int, behind: int) -> DataFrame:
    """(doc_id, pos, window, part, at): every window of ``q`` characters with a stretch of the text that
    has ``before`` characters before its start (NUL where the text has none) and ``behind`` from there on.

    ``at`` counts from 1 in ``part``.  Texts have been spread before; rows that are dropped at once
    cost no copy of ``part``.
    """
    size = size_for(before + behind)
    padded = texts.select("doc_id", F.concat(F.lit("\0" * before), F.col("text")).alias("text"))
    last = F.least(F.lit(size), F.char_length("part") - before - q + 1)
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    rows = chunks(padded, before + behind, size, dealt=True).select("doc_id", "c", "part", F.posexplode(F.transform(starts, lambda i: F.substring("part", i + before, F.lit(q)))).alias("i", "window"))
    return rows.select("doc_id", (F.col("c") * size + F.col("i")).alias("pos"), "window", "part", (F.col("i") + before + 1).alias("at"))


def size_for(longest: int) -> int:
    """The smallest size of pieces of which two hold any stretch of ``longest`` characters."""
    return next((s for s in SIZES if s >= longest), max(longest, SIZES[-1]))


def looked_up(texts: DataFrame, rows: DataFrame, length: Column, longest: int) -> DataFrame:
    """``rows`` (doc_id, pos, ...) with ``w``, up to ``length`` characters (``longest`` at most) from pos on.

    Rows meet the chunk that holds their start, not the text: what is walked for each is
    bounded by the longest stretch asked for, however long the text.
    """
    size = size_for(max(longest, 1))
    held = chunks(texts, size, size).select(F.col("doc_id").alias("_doc"), F.col("c").alias("_c"), F.col("part").alias("_part"))
    met = rows.join(held, (F.col("doc_id") == F.col("_doc")) & (F.floor(F.col("pos") / size) == F.col("_c")))
    return met.select(*rows.columns, F.substring("_part", (F.col("pos") - F.col("_c") * size + 1).cast("int"), length).alias("w"))


def symbols(texts: DataFrame) -> DataFrame:
    """(doc_id, pos, symbol): every character."""
    return windows(texts, 1).withColumnRenamed("window", "symbol")


def array_windows(sequences: DataFrame, q: int) -> DataFrame:
    """(doc_id, pos, window: array) of integer sequences."""
    last = F.size("symbols") - q + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    rows = sequences.select("doc_id", F.posexplode(F.transform(starts, lambda i: F.slice("symbols", i, q))).alias("pos", "window"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "window")


def length_of(patterns: DataFrame, pattern: str = "pattern") -> tuple[int, int]:
    """Shortest (but for empty ones) and longest pattern."""
    low, high = patterns.agg(F.min(F.when(F.char_length(pattern) > 0, F.char_length(pattern))), F.max(F.char_length(pattern))).first()
    return low or 0, high or 0


def seed_classes(rows: DataFrame, length: Column) -> list[tuple[int, int, int]]:
    """(shortest, longest, seed length) of the classes in which ``rows`` with pieces of a length are sought.

    One row for each of SEEDS at most comes to the driver.
    """
    at = F.greatest(*(F.when(length >= s, F.lit(s)) for s in SEEDS))
    found = rows.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(length).alias("low"), F.max(length).alias("high")).where("at IS NOT NULL").collect()
    found.sort(key=lambda r: r.at)
    rough = [r for r in found if r.at >= ROUGH]
    classes = [(r.low, r.high) for r in found if r.at < ROUGH]
    if rough and sum(r.n for r in rough) <= FEW:
        classes.append((rough[0].low, rough[-1].high))
    else:
        classes += [(r.low, r.high) for r in rough]
    return [(low, high, min(low, SEEDS[-1])) for low, high in classes]


def part_bounds(m: Column, parts: int) -> list[Column]:
    """Starts of ``parts`` parts of a pattern of length ``m``, and its end: ``(p * m) div parts``."""
    return [F.floor(m * p / parts).cast("int") for p in range(parts + 1)]
