from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.generate import extension_plan, mutated, repetitive, sample_patterns
from lexiloom.operators import exact

GOLDEN = "This is a test string"


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def patterns(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "pat_id long, pattern string")


def naive(all_texts, all_patterns):
    return sorted((d, p, i) for d, t in enumerate(all_texts) for p, s in enumerate(all_patterns) if s for i in range(len(t)) if t.startswith(s, i))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_golden(spark):
    found = rows(exact.locate(texts(spark, GOLDEN, "aaaa"), patterns(spark, "is", "test", "aa")))
    assert found == [(0, 0, 2), (0, 0, 5), (0, 1, 10), (1, 2, 0), (1, 2, 1), (1, 2, 2)]


def test_counts_with_zeros_and_the_empty_pattern(spark):
    assert rows(exact.count(texts(spark, GOLDEN), patterns(spark, "is", "zz", ""))) == [(0, 2), (1, 0), (2, 22)]


@pytest.mark.parametrize("seed", range(4))
def test_locate_equals_the_naive_scan(spark, seed):
    draw = random.Random(seed)
    t = [repetitive(draw, draw.randrange(1, 900), "acgt" if seed % 2 else "aé") for _ in range(4)] + [""]
    p = sorted({s[i : i + draw.randrange(1, 30)] for s in t if s for i in [draw.randrange(len(s))]} | {"zz"})
    assert rows(exact.locate(texts(spark, *t), patterns(spark, *p))) == naive(t, p)


def test_matches_do_not_cross_texts(spark):
    assert rows(exact.locate(texts(spark, "ACGTNACG", "GGTT"), patterns(spark, "CGGG"))) == []


def test_extensions(spark):
    found = rows(exact.extensions(texts(spark, GOLDEN), patterns(spark, "is"), "right"))
    assert found == [(0, " ", 2)]
    assert rows(exact.extensions(texts(spark, GOLDEN), patterns(spark, "is"), "left")) == [(0, " ", 1), (0, "h", 1)]


@pytest.mark.parametrize("m", [3, 90])
def test_extensions_of_short_and_long_patterns(spark, m):
    t, p = ["xy" + "abc" * 40 + "z", "q" + "abc" * 30], ["abc" * (m // 3), "zz" * m]
    for side in ("left", "right"):
        want: dict = {}
        for d, i, at in naive(t, p):
            beside = at - 1 if side == "left" else at + len(p[i])
            if 0 <= beside < len(t[d]):
                want[i, t[d][beside]] = want.get((i, t[d][beside]), 0) + 1
        assert rows(exact.extensions(texts(spark, *t), patterns(spark, *p), side)) == sorted((i, c, n) for (i, c), n in want.items())


def test_longest_suffix(spark):
    t, p = ["abcabd", "xyz"], ["zzabd", "qqq", "abc", "c", "yz"]
    want = [(i, max((n for n in range(len(s) + 1) if any(s[len(s) - n :] in x for x in t)), default=0)) for i, s in enumerate(p)]
    assert rows(exact.longest_suffix(texts(spark, *t), patterns(spark, *p))) == want


def test_any_order_of_extensions_ends_at_the_same_occurrences(spark):
    t, p = texts(spark, "abracadabra abracadabra"), "acada"
    plan = extension_plan(len(p), 3)
    left = plan.count("left")
    lo = hi = left
    found = exact.locate(t, patterns(spark, p[lo])).select("doc_id", "pat_id", "pos", F.lit(1).alias("m"))
    for side in plan:
        symbol = p[lo - 1] if side == "left" else p[hi + 1]
        lo, hi = (lo - 1, hi) if side == "left" else (lo, hi + 1)
        found = exact.extend(found, t, F.lit(symbol), side)
    assert rows(found.select("pos")) == [(3,), (15,)]


def test_both_strands_reports_a_palindrome_twice(spark):
    assert rows(exact.both_strands(texts(spark, "TTACGTTT"), patterns(spark, "ACGT"))) == [(0, 0, "+", 2), (0, 0, "-", 2)]


def test_pages_and_checks(spark):
    t, p = texts(spark, "aaaa"), patterns(spark, "a")
    found = exact.locate(t, p)
    assert rows(exact.paged(found, 2)) == [(0, 0, 0), (0, 0, 1)]
    assert exact.paged(found, 0).count() == 4
    assert exact.checked(found, t, p).isEmpty()
    assert exact.checked(found.withColumn("pos", F.col("pos") + 9), t, p).count() == 4


def test_integer_patterns(spark):
    s = spark.createDataFrame([(7, [1, 2, 1, 2, 1])], "doc_id long, symbols array<int>")
    p = spark.createDataFrame([(0, [1, 2, 1]), (1, [2]), (2, [3])], "pat_id long, pattern array<int>")
    assert rows(exact.locate_symbols(s, p)) == [(7, 0, 0), (7, 0, 2), (7, 1, 1), (7, 1, 3)]


def test_sampled_patterns_occur_and_are_clean(spark):
    t = texts(spark, "abcdefghij" * 30, "x\nyz" * 50)
    p = sample_patterns(t, 20, 6, seed=1, forbidden="\n")
    assert p.count() == 20
    got = exact.count(t, p)
    assert got.where("n = 0").isEmpty()
    assert p.where(F.col("pattern").contains("\n")).isEmpty()


def test_mutation_is_seeded():
    assert mutated(random.Random(4), "acgtacgt", 3) == mutated(random.Random(4), "acgtacgt", 3)


def test_streams_find_patterns_of_any_length(spark, tmp_path):
    from lexiloom.streaming.search import search_stream

    long = "".join(chr(97 + i * i % 23) + str(i) for i in range(300))
    texts = spark.createDataFrame([(1, "xyz " + long), (2, "no hit")], "doc_id long, text string")
    spark.createDataFrame([(1, long), (2, "xyz"), (3, long[:40]), (4, "q!")], "pat_id long, pattern string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pat_id long, pattern string").parquet(str(tmp_path / "in"))
    found = search_stream(texts, stream, (1, 12))
    out = str(tmp_path / "out")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-at").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(out).select("doc_id", "pat_id", "pos").collect()} == {(1, 1, 4), (1, 2, 0), (1, 3, 4)}
