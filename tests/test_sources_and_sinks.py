from __future__ import annotations

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.formatting import rate_text, size_text, support_suffix, threads_text, time_text
from lexiloom.operators import approximate, exact
from lexiloom.sinks import records
from lexiloom.sources import sequences, tables
from lexiloom.streaming.search import counts_stream, search_stream
from tests.conftest import ROOT
from tests.test_exact import patterns, rows, texts


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b"junk\r\n>s1 desc\r\nACGTn\r\nacg\r\n>s2\r\nGGTT\r\n")
    got = rows(sequences.fasta(spark, str(tmp_path / "a.fa")))
    assert got == [(0, "s1", 1, 8, "ACGTNACG"), (1, "s2", 10, 4, "GGTT")]
    with pytest.raises(ValueError, match="separator"):
        sequences.fasta(spark, str(tmp_path / "a.fa"), separator="A")


def test_fastq_stops_at_a_malformed_record(spark, tmp_path):
    (tmp_path / "r.fq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\r\nGG\r\n+\r\nII\r\nbroken\nAA\n+\nII\n@r4\nCC\n+\nII\n")
    assert rows(sequences.fastq(spark, str(tmp_path / "r.fq"))) == [(0, "r1", "ACGT", "IIII"), (1, "r2", "GG", "II")]


def test_pattern_files_round_trip(spark, tmp_path):
    (tmp_path / "p").write_bytes(b"# number=2 length=3 file=x forbidden=\nabcd\nf")
    got = sequences.pattern_file(spark, str(tmp_path / "p"))
    assert rows(got) == [(0, "abc"), (1, "d\nf")]
    lines = [r.line for r in records.pattern_file(got, "x").orderBy("at").collect()]
    assert "".join(lines) == (tmp_path / "p").read_text()


def test_files_and_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.txt").write_bytes(b"\xe9\x00z")
    (tmp_path / "in" / "a.txt").write_bytes(b"one\ntwo")
    got = [(r.doc_id, r.text) for r in tables.byte_files(spark, str(tmp_path / "in")).orderBy("doc_id").collect()]
    assert got == [(0, "one\ntwo"), (1, "\xe9\x00z")]
    t = texts(spark, "x", "y")
    tables.save_index({"texts": t}, str(tmp_path / "ix"))
    assert rows(tables.load_index(spark, str(tmp_path / "ix"), "texts")["texts"]) == rows(t)


def test_lines(spark):
    t, p = texts(spark, "ACGTACGT", "TTTT"), patterns(spark, "ACGT", "GGG")
    names = spark.createDataFrame([(0, "chr1", 8), (1, "chr2", 4)], "doc_id long, name string, length int")
    found = exact.both_strands(t, p)
    sam = [r.line for r in records.sam_exact(found, p, names).orderBy("pat_id", "rank").collect()]
    assert sam[0] == "pat0\t0\tchr1\t1\t0\t4=\t*\t0\t0\t*\t*"
    assert sam[2] == "pat0\t272\tchr1\t1\t0\t4=\t*\t0\t0\t*\t*"
    bed = [r.line for r in records.bed(found, p, names).orderBy("strand", "pos").collect()]
    assert bed[1] == "chr1\t4\t8\tpat0\t0\t+"
    forward = exact.locate(t, p)
    assert rows(records.positions(forward, p)) == [(0, "0 4 "), (1, "")]
    assert rows(records.counts(exact.count(t, p))) == [(0, "pat0\t2"), (1, "pat1\t0")]
    hist = approximate.histogram_hamming(t, p, 1)
    assert rows(records.histogram(hist, 1))[0] == (0, "pat0\t2\t0")
    head = [r.line for r in records.sam_header(names.withColumnRenamed("doc_id", "seq_id")).orderBy("at").collect()]
    assert head[:2] == ["@HD\tVN:1.6\tSO:unsorted", "@SQ\tSN:chr1\tLN:8"] and head[-1].startswith("@PG")


def test_aligned_reads(spark):
    t = texts(spark, "TTTTACGTTGCATTTTTTTTTTTTTTT")
    names = spark.createDataFrame([(0, "chr1", 27)], "doc_id long, name string, length int")
    reads = spark.createDataFrame([(0, "r0", "ACGTAGCA", "ABCDEFGH"), (1, "r1", "TGCAACGT", "ABCDEFGH"), (2, "r2", "GGGGGGGG", "")], "pat_id long, name string, pattern string, quality string")
    hits = approximate.align_reads(t, reads.select("pat_id", "pattern"), 1, "hamming")
    sam = {r.line.split("\t")[0]: r.line for r in records.sam_approximate(approximate.ranked_hits(hits), reads, names, with_sequence=True).collect()}
    assert sam["r0"] == "r0\t0\tchr1\t5\t60\t4=1X3=\t*\t0\t0\tACGTAGCA\tABCDEFGH\tNM:i:1\tMD:Z:4T3"
    assert sam["r1"] == "r1\t16\tchr1\t5\t60\t8=\t*\t0\t0\tACGTTGCA\tHGFEDCBA\tNM:i:0\tMD:Z:8"
    assert sam["r2"] == "r2\t4\t*\t0\t0\t*\t*\t0\t0\tGGGGGGGG\t*"
    paf = [r.line for r in records.paf(hits, reads, names).orderBy("pat_id").collect()]
    assert paf[0] == "r0\t8\t0\t8\t+\tchr1\t27\t4\t12\t7\t8\t255\tNM:i:1\tcg:Z:4=1X3="
    assert records.sam_approximate(approximate.ranked_hits(hits), reads, names, best=True).count() == 3


def test_stream_of_patterns(spark, tmp_path):
    t = texts(spark, "banana bandana", "cabana")
    patterns(spark, "ana", "ban").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pat_id long, pattern string").parquet(str(tmp_path / "in"))
    found = search_stream(t, stream)
    found.writeStream.format("memory").queryName("found").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("found")) == rows(exact.locate(t, patterns(spark, "ana", "ban")))
    counts_stream(t, stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("counted")) == [(0, 4), (1, 3)] or rows(spark.table("counted")) == rows(exact.count(t, patterns(spark, "ana", "ban")))


def test_spellings():
    assert time_text(2.5e9) == "2.50 s" and size_text(1500) == "1.50 KB" and rate_text(2e9, 1e9) == "2.00 GB/s"
    assert threads_text(1) == "single-threaded" and support_suffix("count") == "count"
    assert records.measurement(a=1, b="x") == "RESULT a=1 b=x"
    with pytest.raises(ValueError):
        support_suffix("other")


def test_command_line(tmp_path):
    (tmp_path / "t.txt").write_text("abracadabra")
    (tmp_path / "p").write_text("# number=2 length=3 file=t forbidden=\nabrcad")
    run = lambda *a: subprocess.run([sys.executable, "-m", "lexiloom", *a], cwd=ROOT, check=True, capture_output=True, text=True, timeout=200)
    run("build", str(tmp_path / "t.txt"), str(tmp_path / "ix"))
    run("locate", str(tmp_path / "ix"), str(tmp_path / "p"), str(tmp_path / "out"))
    lines = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part*")))
    assert lines == "0 7 \n4 \n"


def test_registered_queries_have_plans(spark):
    from lexiloom.plans import catalogue

    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
    assert catalogue.QUERIES["e2_locate"](spark, "/root/testdata/sf0.001").count() > 0
    assert F is not None
