"""Result lines: counts, histograms, occurrences, SAM, BED, PAF, measurements.

Each function gives a DataFrame with the line and the columns that order it; ``write_lines``
writes one file a partition in that order.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.sources.scratch import numbered

TAB = "\t"


def counts(found: DataFrame) -> DataFrame:
    """(pat_id, line): ``pat<i>``, its count."""
    return found.select("pat_id", F.concat_ws(TAB, _named(), F.col("n")).alias("line"))


def histogram(found: DataFrame, k: int) -> DataFrame:
    """(pat_id, line): ``pat<i>`` and its counts for 0 to k mismatches."""
    return found.select("pat_id", F.concat_ws(TAB, _named(), *(F.col(f"c_{e}") for e in range(k + 1))).alias("line"))


def positions(found: DataFrame, patterns: DataFrame, at: str = "pos") -> DataFrame:
    """(pat_id, line): all positions in order, a blank after each; empty where there is none."""
    lists = found.groupBy("pat_id").agg(F.sort_array(F.collect_list(at)).alias("all"))
    line = F.coalesce(F.array_join(F.transform("all", lambda p: F.concat(p.cast("string"), F.lit(" "))), ""), F.lit(""))
    return patterns.select("pat_id").join(lists, "pat_id", "left").select("pat_id", line.alias("line"))


def approximate_positions(found: DataFrame, patterns: DataFrame, at: str = "pos") -> DataFrame:
    """(pat_id, line): ``(pos=.. len=.. err=..) `` for each hit, by position."""
    lists = found.groupBy("pat_id").agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("pos"), "len", "err"))).alias("all"))
    hit = F.transform("all", lambda h: F.format_string("(pos=%d len=%d err=%d) ", h["pos"], h["len"], h["err"]))
    return patterns.select("pat_id").join(lists, "pat_id", "left").select("pat_id", F.coalesce(F.array_join(hit, ""), F.lit("")).alias("line"))


def _named(prefix: str = "pat") -> Column:
    return F.concat(F.lit(prefix), F.col("pat_id").cast("string"))


def sam_header(sequences: DataFrame, program: str = "lexiloom", command: str = "") -> DataFrame:
    """(at, line): version, a line a sequence (seq_id, name, length), the program."""
    spark = sequences.sparkSession
    first = spark.createDataFrame([(-1, "@HD\tVN:1.6\tSO:unsorted")], "at long, line string")
    each = sequences.select(F.col("seq_id").alias("at"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("length").cast("string")).alias("line"))
    last = spark.createDataFrame([(1 << 62, f"@PG\tID:{program}\tPN:{program}\tCL:{command}")], "at long, line string")
    return first.union(each).union(last)


def sam_exact(found: DataFrame, patterns: DataFrame, names: DataFrame) -> DataFrame:
    """(pat_id, rank, line) of exact hits (doc_id, pat_id, strand, pos); ``names`` is (doc_id, name).

    The first hit, forward strand first, is primary; its quality is 60 if it is the only one.
    """
    order = Window.partitionBy("pat_id").orderBy("strand", "doc_id", "pos")
    rows = found.join(patterns.select("pat_id", F.char_length("pattern").alias("m")), "pat_id").join(names, "doc_id")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("_n", F.count("*").over(Window.partitionBy("pat_id")))
    flag = F.when(F.col("rank") == 1, 0).otherwise(256) + F.when(F.col("strand") == "-", 16).otherwise(0)
    mapq = F.when((F.col("rank") == 1) & (F.col("_n") == 1), 60).otherwise(0)
    line = F.concat_ws(TAB, _named(), flag, "name", F.col("pos") + 1, mapq, F.concat(F.col("m").cast("string"), F.lit("=")), F.lit("*\t0\t0\t*\t*"))
    return rows.select("pat_id", "rank", line.alias("line"))


def bed(found: DataFrame, patterns: DataFrame, names: DataFrame) -> DataFrame:
    """(pat_id, strand, doc_id, pos, line): half-open ranges from 0."""
    rows = found.join(patterns.select("pat_id", F.char_length("pattern").alias("m")), "pat_id").join(names, "doc_id")
    line = F.concat_ws(TAB, "name", "pos", F.col("pos") + F.col("m"), _named(), F.lit("0"), "strand")
    return rows.select("pat_id", "strand", "doc_id", "pos", line.alias("line"))


def sam_approximate(hits: DataFrame, reads: DataFrame, names: DataFrame | None = None, best: bool = False, with_sequence: bool = False, cigars: bool = True) -> DataFrame:
    """(pat_id, rank, line) of ranked hits (``ranked_hits``), a record for each unmapped read besides.

    ``reads`` is (pat_id, name, pattern, quality).  Without ``names`` (doc_id, name), hits have the
    column ``name`` themselves, and meet no table of all texts.  Sequence and quality stand on primary
    records only; on the reverse strand the sequence is complemented, the quality reversed.
    """
    from lexiloom.functions.strings import reverse_complement

    reads = reads.select("pat_id", F.col("name").alias("_read"), "pattern", "quality")
    rows = hits.where("primary") if best else hits
    rows = rows.join(names.select("doc_id", "name"), "doc_id") if names else rows
    rows = rows.select("pat_id", "strand", "doc_id", "pos", "len", "name", "primary", "mapq", "err", *(["cigar", "md"] if cigars else []))
    rows = numbered(rows, "pat_id", "strand", "doc_id", "pos", "len").join(reads, "pat_id")
    turned = F.col("strand") == "-"
    flag = F.when(F.col("primary"), 0).otherwise(256) + F.when(turned, 16).otherwise(0)
    shown = F.col("primary") & F.lit(with_sequence)
    seq = F.when(shown, F.when(turned, reverse_complement(F.col("pattern"))).otherwise(F.col("pattern"))).otherwise("*")
    qual = F.when(shown & (F.coalesce("quality", F.lit("")) != ""), F.when(turned, F.reverse("quality")).otherwise(F.col("quality"))).otherwise("*")
    line = F.concat_ws(
        TAB, "_read", flag, "name", F.col("pos") + 1, "mapq", F.col("cigar") if cigars else F.lit("*"), F.lit("*\t0\t0"), seq, qual,
        F.concat(F.lit("NM:i:"), F.col("err").cast("string")), *([F.concat(F.lit("MD:Z:"), "md")] if cigars else []),
    )
    mapped = rows.select("pat_id", "rank", line.alias("line"))
    lost = reads.join(hits.select("pat_id").distinct(), "pat_id", "left_anti")
    own = F.when(F.lit(with_sequence), F.col("pattern")).otherwise("*")
    own_q = F.when(F.lit(with_sequence) & (F.coalesce("quality", F.lit("")) != ""), F.col("quality")).otherwise("*")
    unmapped = lost.select("pat_id", F.lit(0).alias("rank"), F.concat_ws(TAB, "_read", F.lit("4\t*\t0\t0\t*\t*\t0\t0"), own, own_q).alias("line"))
    return mapped.union(unmapped)


def paf(hits: DataFrame, reads: DataFrame, names: DataFrame, cigars: bool = True) -> DataFrame:
    """(pat_id, strand, doc_id, pos, line); ``names`` is (doc_id, name, length)."""
    if cigars:
        block = F.aggregate("runs", F.lit(0), lambda n, r: n + r["len"])
        matches = F.aggregate("runs", F.lit(0), lambda n, r: n + F.when(r["op"] == "=", r["len"]).otherwise(0))
    else:
        block, matches = F.col("len"), F.greatest(F.col("len") - F.col("err"), F.lit(0))
    # counted before the join with the names, so that scripts are not moved
    rows = hits.select("doc_id", "pat_id", "strand", "pos", "len", "err", *(["cigar"] if cigars else []), block.alias("_block"), matches.alias("_matches"))
    rows = rows.join(reads.select("pat_id", F.col("name").alias("_read"), F.char_length("pattern").alias("_m")), "pat_id").join(names, "doc_id")
    line = F.concat_ws(
        TAB, "_read", "_m", F.lit("0"), "_m", "strand", "name", "length", "pos", F.col("pos") + F.col("len"), "_matches", "_block", F.lit("255"),
        F.concat(F.lit("NM:i:"), F.col("err").cast("string")), *([F.concat(F.lit("cg:Z:"), "cigar")] if cigars else []),
    )
    return rows.select("pat_id", "strand", "doc_id", "pos", line.alias("line"))


def pattern_file(patterns: DataFrame, file: str, forbidden: str = "") -> DataFrame:
    """(at, line): the header of a pattern file, then its patterns, which go on one line."""
    n, m = patterns.agg(F.count("*"), F.max(F.char_length("pattern"))).first()
    header = patterns.sparkSession.createDataFrame([(-1, f"# number={n} length={m or 0} file={file} forbidden={forbidden}\n")], "at long, line string")
    return header.union(patterns.select(F.col("pat_id").alias("at"), F.col("pattern").alias("line")))


def measurement(**values) -> str:
    """A ``RESULT key=value`` line."""
    return " ".join(["RESULT", *(f"{k}={v}" for k, v in values.items())])


def measurement_json(**values) -> str:
    return json.dumps(values, sort_keys=True)


def write_lines(lines: DataFrame, path: str, *order: str, single: bool = False) -> None:
    """Writes the column ``line`` in order; ``single`` makes one file, for results of one machine's size."""
    ordered = lines.orderBy(*order)
    (ordered.coalesce(1) if single else ordered).select("line").write.mode("overwrite").text(path)
