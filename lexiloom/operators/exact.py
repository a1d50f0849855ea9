"""Exact search: texts and patterns meet in equi-joins on the patterns' first characters.

Patterns are grouped by the length of their seed (``windows.seed_classes``), one join for each
class in use: a short pattern costs a join of its own and no other pattern anything.  What
follows the seed is compared with up to ``TAIL`` characters that are taken with the window;
hits of longer patterns meet the chunk that holds them.  The join is left to the optimizer: a
small pattern table is broadcast, a large one is shuffled with skewed seeds split at run time.
Occurrences overlap, positions count from 0, and a pattern with a symbol that no text has
finds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.strings import common_prefix, reverse_complement
from lexiloom.operators.windows import array_windows, length_of, looked_up, seed_classes, windows, windows_with_tail

TAIL = 64
#: Suffixes below this length are looked up among all short strings of the texts.
SHORT = 6


def matches(texts: DataFrame, patterns: DataFrame, behind: int = 0) -> DataFrame:
    """(doc_id, pat_id, pos, m, w) for every occurrence of every not empty pattern: ``w`` is the
    pattern, of m characters, and up to ``behind`` characters that follow it."""
    m = F.char_length("pattern")
    found = None
    for low, high, q in seed_classes(patterns, m):
        some = patterns.where(m.between(low, high))
        seeds = some.select("pat_id", "pattern", m.alias("m"), F.substring("pattern", 1, q).alias("window"))
        if high + behind <= TAIL:
            hits = windows_with_tail(texts, q, high + behind).join(seeds, "window")
            hits = hits.withColumn("w", F.expr(f"left(tail, m + {behind})"))
        else:
            hits = windows(texts, q).join(seeds, "window").select("doc_id", "pat_id", "pos", "pattern", "m")
            hits = looked_up(texts, hits, F.col("m") + behind, high + behind)
        hits = hits.where(F.col("w").startswith(F.col("pattern"))).select("doc_id", "pat_id", "pos", "m", "w")
        found = hits if found is None else found.union(hits)
    if found is None:
        return texts.sparkSession.createDataFrame([], "doc_id long, pat_id long, pos long, m int, w string")
    return found


def locate(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, pat_id, pos) for every occurrence of every not empty pattern."""
    return matches(texts, patterns).select("doc_id", "pat_id", "pos")


def count(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pat_id, n): occurrences over all texts, zeros included.

    The empty pattern has a text's length plus one occurrences in it.
    """
    found = locate(texts, patterns).groupBy("pat_id").agg(F.count("*").alias("n"))
    everywhere = texts.agg(F.sum(F.char_length("text") + 1).alias("all"))
    rows = patterns.select("pat_id", "pattern").join(found, "pat_id", "left")
    empty = rows.where(F.col("pattern") == "").join(everywhere).select("pat_id", F.coalesce("all", F.lit(0)).cast("long").alias("n"))
    return rows.where(F.col("pattern") != "").select("pat_id", F.coalesce("n", F.lit(0)).cast("long").alias("n")).union(empty)


def first_occurrence(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, pat_id, pos): the first of each document's occurrences."""
    return locate(texts, patterns).groupBy("doc_id", "pat_id").agg(F.min("pos").alias("pos"))


def prepend(frontier: DataFrame, texts: DataFrame, symbol) -> DataFrame:
    """One step to the left: occurrences (doc_id, pat_id, pos, m) preceded by ``symbol``."""
    return extend(frontier, texts, symbol, "left")


def extend(frontier: DataFrame, texts: DataFrame, symbol, side: str) -> DataFrame:
    """Occurrences (doc_id, pat_id, pos, m) extended by ``symbol`` (a column of theirs) on a side."""
    rows = frontier.join(texts, "doc_id").where(neighbour(side) == symbol)
    return rows.select("doc_id", "pat_id", (F.col("pos") - 1 if side == "left" else F.col("pos")).alias("pos"), (F.col("m") + 1).alias("m"))


def neighbour(side: str):
    """The symbol beside an occurrence; empty at the ends of a text."""
    if side == "left":
        return F.when(F.col("pos") > 0, F.substring("text", F.col("pos").cast("int"), F.lit(1))).otherwise("")
    return F.substring("text", (F.col("pos") + F.col("m") + 1).cast("int"), F.lit(1))


def extensions(texts: DataFrame, patterns: DataFrame, side: str) -> DataFrame:
    """(pat_id, symbol, n): the symbols that extend each pattern on a side, and how often.

    Those on the left are those on the right of the reversed patterns in the reversed texts.
    """
    if side == "left":
        texts = texts.select("doc_id", F.reverse("text").alias("text"))
        patterns = patterns.select("pat_id", F.reverse("pattern").alias("pattern"))
    symbol = matches(texts, patterns, 1).select("pat_id", F.expr("substring(w, m + 1, 1)").alias("symbol"))
    return symbol.where("symbol <> ''").groupBy("pat_id", "symbol").agg(F.count("*").alias("n"))


def longest_suffix(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pat_id, length): the longest suffix of each pattern that occurs in a text, 0 for none.

    Searched as prefixes of the reversed patterns in the reversed texts: those of SHORT
    characters or more by a join on the first SHORT, shorter ones by all that texts have.
    """
    back = texts.select("doc_id", F.reverse("text").alias("text"))
    turned = patterns.select("pat_id", F.reverse("pattern").alias("pattern"))
    longest = max(length_of(patterns)[1], SHORT)
    heads = windows_with_tail(back, 1, SHORT - 1).select("tail").distinct()
    heads = heads.select(F.explode(F.expr("transform(sequence(1, char_length(tail)), i -> left(tail, i))")).alias("head")).distinct()
    asked = turned.select("pat_id", F.explode(F.expr(f"transform(sequence(1, {SHORT - 1}), i -> left(pattern, i))")).alias("head"))
    short = asked.join(heads, "head").select("pat_id", F.char_length("head").alias("length"))
    seeds = turned.select("pat_id", "pattern", F.substring("pattern", 1, SHORT).alias("window"))
    hits = windows(back, SHORT).join(seeds, "window").select("doc_id", "pos", "pat_id", "pattern")
    rows = looked_up(back, hits, F.char_length("pattern"), longest)
    long = rows.select("pat_id", common_prefix(F.col("pattern"), F.col("w")).alias("length"))
    found = short.union(long).groupBy("pat_id").agg(F.max("length").alias("length"))
    return patterns.select("pat_id").join(found, "pat_id", "left").select("pat_id", F.coalesce("length", F.lit(0)).alias("length"))


def both_strands(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, pat_id, strand, pos): patterns and their reverse complements."""
    forward = locate(texts, patterns).select("doc_id", "pat_id", F.lit("+").alias("strand"), "pos")
    turned = patterns.select("pat_id", reverse_complement(F.col("pattern")).alias("pattern"))
    return forward.union(locate(texts, turned).select("doc_id", "pat_id", F.lit("-").alias("strand"), "pos"))


def locate_symbols(sequences: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, pat_id, pos) of integer patterns (pat_id, pattern: array) in (doc_id, symbols)."""
    lengths = [r[0] for r in patterns.select(F.size("pattern")).distinct().collect() if r[0] > 0]
    found = [
        array_windows(sequences, m).join(patterns.where(F.size("pattern") == m), F.col("window") == F.col("pattern")).select("doc_id", "pat_id", "pos")
        for m in sorted(lengths)
    ]
    out = found[0] if found else sequences.sparkSession.createDataFrame([], "doc_id long, pat_id long, pos long")
    for more in found[1:]:
        out = out.union(more)
    return out


def paged(found: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` occurrences of each pattern, by document and position; all for 0."""
    if not limit:
        return found
    rank = F.row_number().over(Window.partitionBy("pat_id").orderBy("doc_id", "pos"))
    return found.withColumn("_k", rank).where(F.col("_k") <= limit).drop("_k")


def checked(found: DataFrame, texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Occurrences that do not hold when compared with the text: none, if all is well."""
    rows = found.join(patterns.select("pat_id", "pattern"), "pat_id")
    held = looked_up(texts, rows, F.char_length("pattern"), length_of(patterns)[1]).where("w = pattern").select(found.columns)
    return found.join(held, found.columns, "left_anti")
