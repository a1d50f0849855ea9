from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from lexiloom.functions import alignment as A
from lexiloom.operators import approximate
from lexiloom.sinks import records
from lexiloom.sources.scratch import numbered
from tests.test_approximate import naive_edit
from tests.test_exact import patterns, texts


def turned(p):
    return p[::-1].translate(str.maketrans("ACGT", "TGCA"))


def moved(spark, df) -> int:
    """Rows that a query writes to shuffles."""
    sc = spark.sparkContext
    store, empty = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def so_far():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, empty, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = so_far()
    df.collect()
    return so_far() - before


def drawn(seed):
    draw = random.Random(seed)
    t = ["".join(draw.choice("ACGT") for _ in range(n)) for n in (0, 2, 40, 150)]
    reads = [t[3][a : a + m] for m in (5, 14, 24, 40) for a in (0, 150 - m)]
    return t, [r[:3] + "A" + r[4 + seed % 2 :] for r in reads]


def test_reads_of_both_strands_equal_the_naive_scan(spark):
    t, reads = drawn(1)
    want = sorted((d, i, s, *hit) for d, x in enumerate(t) for i, r in enumerate(reads) for s, p in (("+", r), ("-", turned(r))) for hit in naive_edit(x, p, 2))
    found = approximate.align_reads(texts(spark, *t), patterns(spark, *reads), 2, filtered=False).collect()
    assert sorted((r.doc_id, r.pat_id, r.strand, r.pos, r.len, r.err) for r in found) == want
    for r in found:
        p = reads[r.pat_id] if r.strand == "+" else turned(reads[r.pat_id])
        assert A.script_edits(p, t[r.doc_id][r.pos : r.pos + r.len], [tuple(x) for x in r.runs]) == r.err


def test_a_read_moves_no_unverified_candidates(spark):
    """Reads of 12 bases meet seeds of four nearly everywhere; what is moved is bounded by the hits."""
    draw, m = random.Random(1), 12
    t = "".join(draw.choice("ACGT") for _ in range(20_000))
    hits = approximate.align_reads(texts(spark, t), patterns(spark, t[100 : 100 + m], t[9000 : 9000 + m]), 2)
    assert moved(spark, hits) <= 20 * hits.count() + 20
    assert moved(spark, approximate.ranked_hits(hits)) <= 20 * hits.count() + 40


def test_paf_joins_names_without_scripts(spark):
    hits = spark.createDataFrame([(7, 1, "+", 4, 3, 1, "2=1X", "2A0", [("=", 2, None), ("X", 1, "A")])], f"doc_id long, pat_id long, strand string, pos long, len int, err int, cigar string, md string, runs {A.RUNS}")
    reads = spark.createDataFrame([(1, "r", "CCG")], "pat_id long, name string, pattern string")
    lines = records.paf(hits, reads, spark.createDataFrame([(7, "d", 9)], "doc_id long, name string, length int"))
    assert [r.line for r in lines.collect()] == ["r\t3\t0\t3\t+\td\t9\t4\t7\t2\t3\t255\tNM:i:1\tcg:Z:2=1X"]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("aggregate(runs") > plan.rindex("Join") and plan.index("aggregate(runs") > plan.index("Join")


def test_sam_moves_records_once(spark):
    """Names come with the hits; records are moved for their rank only, whatever the number of texts."""
    draw = random.Random(2)
    t = texts(spark, *("".join(draw.choice("ACGT") for _ in range(2000)) for _ in range(20)))
    reads = spark.createDataFrame([(i, f"r{i}", p, "") for i, p in enumerate(["ACGTAC", "GATTACA", "A" * 30])], "pat_id long, name string, pattern string, quality string")
    named = t.withColumn("name", F.concat(F.lit("t"), "doc_id"))
    hits = approximate.ranked_hits(approximate.align_reads(named, reads.select("pat_id", "pattern"), 2).drop("runs"))
    n = hits.count()
    assert n > 1000
    lines = records.sam_approximate(hits, reads)
    assert moved(spark, SimpleNamespace(collect=lambda: records.sam_approximate(hits, reads).collect())) <= n + 200
    joined = records.sam_approximate(hits.drop("name"), reads, named.select("doc_id", "name"))
    assert sorted(lines.collect()) == sorted(joined.collect()) and lines.count() == n + 1


def test_ranks_of_one_key_are_counted_over_slices(spark):
    rows = spark.range(5000).select(F.floor(F.col("id") / 4990).alias("key"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = numbered(rows, "key", "x").withColumn("slice", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for key in (0, 1):
        own = sorted((r.x, r.rank) for r in out if r.key == key)
        assert [rank for _, rank in own] == list(range(1, len(own) + 1))


def test_one_pass_equals_joins(spark):
    t, reads = drawn(3)
    reads += [reads[-1] + "N" * 3, t[3][10:100], "AC", "G"]
    for filtered in (False, True):
        one, many = (sorted(approximate.align_reads(texts(spark, *t, "ACNNNGT"), patterns(spark, *reads), 2, filtered=filtered, few=few).collect()) for few in (100, 0))
        assert one == many and len(one) > 100


def test_spellings_equal_those_of_scripts():
    draw, k = random.Random(4), 3
    for m in (4, 9, 60):
        t = "".join(draw.choice("AC") for _ in range(800)) if m < 60 else "".join(draw.choice("ACGT") for _ in range(800))
        p = t[50 : 50 + m]
        codes, p_codes = (np.array([*map(ord, x)] + [-1] * pad, np.int32) for x, pad in ((t, m + k), (p, 0)))
        at, err, length = A.starts_within(codes, p_codes, k)
        assert sorted(zip(at, length, err)) == sorted(naive_edit(t, p, k))
        scripts = [A.edit_script(p, t[a : a + n], k)[1] for a, n in zip(at, length)]
        assert [A.spelled_edits(m, tuple(x)) for x in A.edits(codes, p_codes, at, length, err, k).tolist()] == [(A.cigar(s), A.md(s)) for s in scripts]
