"""Command line: build, count, locate, align, revert, patterns, bench.

    python -m lexiloom build TEXTS INDEX [--fasta]
    python -m lexiloom count INDEX PATTERNS OUT [-k K] [--histogram]
    python -m lexiloom locate INDEX PATTERNS OUT [-k K] [--metric edit] [--format text|sam|bed|paf] [--fastq] [--best] [--seq] [--no-rc] [--no-cigar]
    python -m lexiloom revert INDEX OUT [--left L --right R]
    python -m lexiloom patterns INDEX OUT -n N -m LENGTH [--forbidden CHARS] [--seed SEED]
    python -m lexiloom bench INDEX [-k K ...] [-m LENGTH ...] [-a A ...] [-n N] [--metric ...] [--only match|extend|balance ...] [--budget SECONDS]
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import ship
from lexiloom.functions.generate import sample_patterns
from lexiloom.operators import approximate, exact, suffix
from lexiloom.plans import grid
from lexiloom.sinks import records
from lexiloom.sources import scratch, sequences, tables


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("lexiloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build")
    build.add_argument("texts")
    build.add_argument("index")
    build.add_argument("--fasta", action="store_true")
    for name in ("count", "locate"):
        p = sub.add_parser(name)
        p.add_argument("index")
        p.add_argument("patterns")
        p.add_argument("out")
        p.add_argument("-k", type=int, default=0)
        p.add_argument("--fastq", action="store_true")
        p.add_argument("--limit", type=int, default=0)
        p.add_argument("--metric", choices=["hamming", "edit"], default="hamming")
        p.add_argument("--histogram", action="store_true")
        p.add_argument("--format", choices=["text", "sam", "bed", "paf"], default="text")
        for flag in ("--best", "--seq", "--no-rc", "--no-cigar", "--check"):
            p.add_argument(flag, action="store_true")
    revert = sub.add_parser("revert")
    revert.add_argument("index")
    revert.add_argument("out")
    revert.add_argument("--left", type=int, default=1)
    revert.add_argument("--right", type=int, default=0)
    make = sub.add_parser("patterns")
    make.add_argument("index")
    make.add_argument("out")
    make.add_argument("-n", type=int, required=True)
    make.add_argument("-m", type=int, required=True)
    make.add_argument("--forbidden", default="")
    make.add_argument("--seed", type=int, default=42)
    timed = sub.add_parser("bench")
    timed.add_argument("index")
    timed.add_argument("-k", type=int, nargs="*", default=list(grid.ERRORS))
    timed.add_argument("-m", type=int, nargs="*", default=list(grid.LENGTHS))
    timed.add_argument("-a", type=int, nargs="*", default=list(grid.BALANCES))
    timed.add_argument("-n", type=int, default=100)
    timed.add_argument("--metric", choices=["hamming", "edit"], nargs="*", default=["hamming", "edit"])
    timed.add_argument("--only", choices=grid.KINDS, nargs="*", default=list(grid.KINDS))
    timed.add_argument("--seed", type=int, default=42)
    timed.add_argument("--budget", type=float, default=float("inf"))
    return top


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.fasta:
        rows = sequences.fasta(spark, a.texts)
        texts = rows.select(F.col("seq_id").alias("doc_id"), "text", "name", "start", "length")
    else:
        rows = tables.byte_files(spark, a.texts)
        texts = rows.select("doc_id", "text", "name", F.lit(None).cast("long").alias("start"), F.char_length("text").cast("long").alias("length"))
    tables.save_index({"texts": texts}, a.index)


def patterns_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """(pat_id, name, pattern, quality)."""
    if a.fastq:
        return sequences.fastq(spark, a.patterns)
    name = F.concat(F.lit("pat" if not a.k else "read"), F.col("pat_id").cast("string"))
    return sequences.pattern_file(spark, a.patterns).select("pat_id", name.alias("name"), "pattern", F.lit("").alias("quality"))


def count(spark: SparkSession, a: argparse.Namespace) -> None:
    texts, patterns = tables.load_index(spark, a.index, "texts")["texts"], patterns_of(spark, a)
    if a.histogram:
        lines = records.histogram(approximate.histogram_hamming(texts, patterns, a.k), a.k)
    else:
        lines = records.counts(approximate.count_hamming(texts, patterns, a.k) if a.k else exact.count(texts, patterns))
    records.write_lines(lines, a.out, "pat_id")


def locate(spark: SparkSession, a: argparse.Namespace) -> None:
    texts, reads = tables.load_index(spark, a.index, "texts")["texts"], patterns_of(spark, a)
    patterns, names = reads.select("pat_id", "pattern"), texts.select("doc_id", "name", "length")
    if a.format == "text":
        found = approximate.locate(texts, patterns, a.k, a.metric) if a.k else exact.locate(texts, patterns)
        if a.check and not a.k and not exact.checked(found, texts, patterns).isEmpty():
            sys.exit("an occurrence does not hold")
        found = exact.paged(found, a.limit).join(texts.select("doc_id", F.coalesce("start", F.lit(0)).alias("start")), "doc_id").withColumn("pos", F.col("pos") + F.col("start"))
        lines = records.approximate_positions(found, patterns) if a.k else records.positions(found, patterns)
        return records.write_lines(lines, a.out, "pat_id")
    sequences_ = texts.select(F.col("doc_id").alias("seq_id"), "name", "length")
    if not a.k:
        found = exact.locate(texts, patterns).withColumn("strand", F.lit("+")) if a.no_rc else exact.both_strands(texts, patterns)
        lines = records.sam_exact(found, patterns, names) if a.format == "sam" else records.bed(found, patterns, names)
        order = ("pat_id", "rank") if a.format == "sam" else ("pat_id", "strand", "doc_id", "pos")
    else:
        hits = approximate.align_reads(texts, patterns, a.k, a.metric, reverse=not a.no_rc)
        if a.format == "paf":
            lines, order = records.paf(hits, reads, names, not a.no_cigar), ("pat_id", "strand", "doc_id", "pos")
        else:
            lines = records.sam_approximate(approximate.ranked_hits(hits), reads, names, a.best, a.seq, not a.no_cigar)
            order = ("pat_id", "rank")
    if a.format == "sam":
        header = records.sam_header(sequences_, command=" ".join(sys.argv[1:])).select(F.lit(-1).cast("long").alias("pat_id"), F.col("at").alias("rank"), "line")
        lines = header.union(lines.select("pat_id", F.col("rank").cast("long"), "line"))
    return records.write_lines(lines, a.out, *order)


def revert(spark: SparkSession, a: argparse.Namespace) -> None:
    parts = suffix.text_range(tables.load_index(spark, a.index, "texts")["texts"], a.left, a.right)
    parts.orderBy("doc_id").select("part").write.mode("overwrite").text(a.out)


def patterns(spark: SparkSession, a: argparse.Namespace) -> None:
    texts = tables.load_index(spark, a.index, "texts")["texts"]
    made = sample_patterns(texts, a.n, a.m, a.seed, a.forbidden)
    lines = records.pattern_file(made, a.index, a.forbidden).orderBy("at").coalesce(1)
    _joined(lines, a.out)


def bench(spark: SparkSession, a: argparse.Namespace) -> None:
    texts = tables.load_index(spark, a.index, "texts")["texts"].select("doc_id", "text")
    chosen = grid.cells(a.k, a.m, a.metric, a.only, a.a)
    for row in grid.run(texts, chosen, a.n, a.seed, scratch.stored, a.budget):
        print(json.dumps(row), flush=True)


def _joined(lines: DataFrame, path: str) -> None:
    """Header and patterns as one text without line ends between patterns."""
    body = lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "").alias("value"))
    body.write.mode("overwrite").text(path, lineSep="\n")


def main() -> None:
    a = arguments().parse_args()
    spark = SparkSession.builder.appName("lexiloom").getOrCreate()
    ship(spark)
    began = time.time()
    {"build": build, "count": count, "locate": locate, "revert": revert, "patterns": patterns, "bench": bench}[a.command](spark, a)
    print(records.measurement(command=a.command, seconds=round(time.time() - began, 3)))


if __name__ == "__main__":
    main()
