"""Suffix arrays and Burrows-Wheeler transforms as tables, and what follows from them.

Row i of a document's table is its i-th smallest suffix, the empty one (the sentinel) first.
``suffix_array`` sorts suffixes in a window for each document, good for texts of some
thousand characters; ``suffix_array_by_doubling`` ranks all positions of all documents by
prefix doubling, in rounds of equi-joins whose number is the logarithm of the longest repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.strings import common_prefix


def suffixes(texts: DataFrame) -> DataFrame:
    """(doc_id, sa, suffix), the empty suffix included."""
    return texts.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.char_length("text"))).alias("sa")).select(
        "doc_id", F.col("sa").cast("long").alias("sa"), F.substring("text", F.col("sa") + 1, F.char_length("text")).alias("suffix"), "text"
    )


def suffix_array(texts: DataFrame, keep_suffix: bool = False) -> DataFrame:
    """(doc_id, i, sa, bwt[, suffix]); bwt is the symbol before the suffix, '' for the whole text."""
    rows = suffixes(texts)
    i = (F.row_number().over(Window.partitionBy("doc_id").orderBy("suffix")) - 1).cast("long").alias("i")
    bwt = F.when(F.col("sa") == 0, "").otherwise(F.substring("text", F.col("sa").cast("int"), F.lit(1))).alias("bwt")
    return rows.select("doc_id", i, "sa", bwt, *(["suffix"] if keep_suffix else []))


def suffix_array_by_doubling(symbols: DataFrame, stored=lambda df: df.checkpoint()) -> DataFrame:
    """(doc_id, i, sa) of (doc_id, pos, symbol), for texts of any length.

    Round t ranks suffixes by their first 2 ** t symbols: a self-join with the rank at pos +
    2 ** (t - 1), and a rank within each document by two-level counting: distinct pairs are
    ranked, then joined back.  Rows of rank 0 stand for the ends of texts.
    """
    ends = symbols.groupBy("doc_id").agg((F.max("pos") + 1).alias("pos")).select("doc_id", "pos", F.lit(None).cast("string").alias("symbol"))
    rows = symbols.select("doc_id", "pos", "symbol").union(ends)
    ranks = stored(_ranked(rows.withColumn("other", F.lit(0).cast("long")).withColumnRenamed("symbol", "first")))
    step = 1
    while True:
        counts = ranks.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("r").alias("d"))
        if counts.where("n > d").isEmpty():
            return ranks.select("doc_id", F.col("r").alias("i"), F.col("pos").alias("sa"))
        next_ = ranks.select("doc_id", (F.col("pos") - step).alias("pos"), F.col("r").alias("other"))
        pairs = ranks.join(next_, ["doc_id", "pos"], "left").select("doc_id", "pos", F.col("r").alias("first"), F.coalesce("other", F.lit(-1).cast("long")).alias("other"))
        ranks = stored(_ranked(pairs))
        step *= 2


def _ranked(pairs: DataFrame) -> DataFrame:
    """(doc_id, pos, r): the number of positions of a document with a smaller (first, other)."""
    sizes = pairs.groupBy("doc_id", "first", "other").agg(F.count("*").alias("n"))
    before = Window.partitionBy("doc_id").orderBy(F.col("first").asc_nulls_first(), "other").rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.select(F.col("doc_id").alias("_d"), F.col("first").alias("_f"), F.col("other").alias("_o"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("r"))
    on = (F.col("doc_id") == F.col("_d")) & F.col("first").eqNullSafe(F.col("_f")) & (F.col("other") == F.col("_o"))
    return pairs.join(ranks, on).select("doc_id", "pos", "r")


def columns(sa: DataFrame) -> DataFrame:
    """Adds run, lf, phi, phi_inv, dsa: BWT run, last-to-first mapping, the positions of the suffix
    before and of the next, the difference to the suffix before (in cyclic reading, the first row
    follows the last one)."""
    order = Window.partitionBy("doc_id").orderBy("i")
    head = F.coalesce((F.col("bwt") != F.lag("bwt").over(order)).cast("int"), F.lit(0))
    rows = sa.withColumn("_head", head)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("sa").over(whole), F.last("sa").over(whole)
    return (
        rows.withColumn("run", F.sum("_head").over(order).cast("long"))
        .withColumn("lf", (F.row_number().over(Window.partitionBy("doc_id").orderBy("bwt", "i")) - 1).cast("long"))
        .withColumn("phi", F.coalesce(F.lag("sa").over(order), last))
        .withColumn("phi_inv", F.coalesce(F.lead("sa").over(order), first))
        .withColumn("dsa", F.col("sa") - F.coalesce(F.lag("sa").over(order), F.lit(0)))
        .drop("_head")
    )


def runs(table: DataFrame) -> DataFrame:
    """(doc_id, run, sym, start, len, first_sa, last_sa, q): the BWT run by run, with the suffix
    positions at its ends and where the LF-mapping takes its start."""
    return table.groupBy("doc_id", "run").agg(
        F.min("bwt").alias("sym"), F.min("i").alias("start"), F.count("*").alias("len"),
        F.min_by("sa", "i").alias("first_sa"), F.max_by("sa", "i").alias("last_sa"), F.min("lf").alias("q"),
    )


def lcp(sa: DataFrame) -> DataFrame:
    """(doc_id, i, lcp) from rows with their suffix: the common prefix with the one before, 0 first."""
    order = Window.partitionBy("doc_id").orderBy("i")
    return sa.select("doc_id", "i", F.coalesce(common_prefix(F.col("suffix"), F.lag("suffix").over(order)), F.lit(0)).alias("lcp"))


def plcp(sa: DataFrame) -> DataFrame:
    """(doc_id, pos, plcp): lcp values by text position."""
    return lcp(sa).join(sa.select("doc_id", "i", "sa"), ["doc_id", "i"]).select("doc_id", F.col("sa").alias("pos"), F.col("lcp").alias("plcp"))


def inverse(sa: DataFrame) -> DataFrame:
    """(doc_id, pos, i): the rank of the suffix at each position."""
    return sa.select("doc_id", F.col("sa").alias("pos"), "i")


def samples(sa: DataFrame, every: int) -> DataFrame:
    return sa.where(F.col("i") % every == 0)


def intervals(sa: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, pat_id, b, e): inclusive ranges of the suffixes that start with each pattern.

    An equi-join on the pattern's length and the suffix's first characters.
    """
    lengths = patterns.select(F.char_length("pattern").alias("m")).distinct()
    heads = sa.join(F.broadcast(lengths), F.char_length("suffix") >= F.col("m")).select("doc_id", "i", F.expr("left(suffix, m)").alias("pattern"))
    return heads.join(patterns.select("pat_id", "pattern"), "pattern").groupBy("doc_id", "pat_id").agg(F.min("i").alias("b"), F.max("i").alias("e"))


def boundaries(sa: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, pat_id, lower, upper): how many suffixes are smaller than each pattern, and how many
    are smaller or begin with it; for patterns that do not occur as well.

    Suffixes and patterns are sorted together, a document at a time; every pattern is asked of every document.
    """
    docs = sa.select("doc_id").distinct()
    ends = patterns.select("pat_id", F.explode(F.array(F.struct(F.col("pattern").alias("key"), F.lit(0).alias("end")), F.struct(F.concat("pattern", F.lit("\U0010ffff")).alias("key"), F.lit(1).alias("end")))).alias("x"))
    asked = docs.crossJoin(F.broadcast(ends)).select("doc_id", "x.key", F.lit(0).alias("is_suffix"), "pat_id", "x.end")
    both = asked.union(sa.select("doc_id", F.col("suffix").alias("key"), F.lit(1), F.lit(None).cast("long"), F.lit(None).cast("int")))
    before = Window.partitionBy("doc_id").orderBy("key", "is_suffix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = both.withColumn("n", F.sum("is_suffix").over(before)).where("is_suffix = 0")
    pick = lambda e: F.max(F.when(F.col("end") == e, F.col("n")))
    return told.groupBy("doc_id", "pat_id").agg(pick(0).alias("lower"), pick(1).alias("upper"))


def sizes(table: DataFrame) -> DataFrame:
    """(doc_id, n, n_runs, n_symbols, per_run): what an index of each document has to hold."""
    found = table.groupBy("doc_id").agg(F.count("*").alias("n"), (F.max("run") + 1).alias("n_runs"), F.countDistinct("bwt").alias("n_symbols"))
    return found.withColumn("per_run", F.col("n") / F.col("n_runs"))


def backward_step(intervals_: DataFrame, table: DataFrame, symbol) -> DataFrame:
    """(doc_id, pat_id, b, e) of the patterns with ``symbol`` (a column of theirs) put before.

    Rows of the interval whose BWT symbol it is, mapped by LF; none if there is no such row.
    """
    asked = intervals_.withColumn("_s", symbol)
    rows = asked.join(table.select("doc_id", "i", "bwt", "lf"), "doc_id").where((F.col("i") >= F.col("b")) & (F.col("i") <= F.col("e")) & (F.col("bwt") == F.col("_s")))
    return rows.groupBy("doc_id", "pat_id").agg(F.min("lf").alias("b"), F.max("lf").alias("e"))


def symbol_counts(symbols: DataFrame) -> DataFrame:
    """(symbol, n, before): frequency, and how many symbols are smaller (the array C)."""
    counts = symbols.groupBy("symbol").agg(F.count("*").alias("n"))
    before = Window.orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)  # a row for each symbol
    return counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def f_column(table: DataFrame) -> DataFrame:
    """(doc_id, i, f): the first symbol of each suffix in order, '' for the empty one."""
    return table.select("doc_id", F.col("lf").alias("i"), F.col("bwt").alias("f"))


def fl(table: DataFrame) -> DataFrame:
    """(doc_id, i, fl): the inverse of the LF-mapping."""
    return table.select("doc_id", F.col("lf").alias("i"), F.col("i").alias("fl"))


def text_range(texts: DataFrame, left: int, right: int) -> DataFrame:
    """(doc_id, part): characters left to right, both included; the whole text if left > right."""
    part = F.col("text") if left > right else F.substring("text", left + 1, right - left + 1)
    return texts.select("doc_id", part.alias("part"))


def table_range(table: DataFrame, left: int, right: int, *names: str) -> DataFrame:
    """Rows left to right of every document's table: ranges of SA, BWT or any column."""
    rows = table if left > right else table.where(F.col("i").between(left, right))
    return rows.select("doc_id", "i", *names)


def reverted(table: DataFrame) -> DataFrame:
    """(doc_id, text) from a table's sa and bwt: the symbol before each suffix, in text order."""
    pairs = F.sort_array(F.collect_list(F.struct("sa", "bwt")))
    return table.groupBy("doc_id").agg(F.array_join(F.transform(pairs, lambda p: p["bwt"]), "").alias("text"))
