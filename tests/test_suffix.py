from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.generate import repetitive
from lexiloom.operators import compressed, intervals, rank_select, suffix
from lexiloom.operators.windows import symbols
from lexiloom.sources import scratch
from tests.test_exact import patterns, rows, texts

GOLDEN = "This is a test string"
SA = [21, 7, 4, 14, 9, 0, 8, 11, 20, 1, 18, 5, 2, 19, 17, 6, 3, 12, 15, 13, 10, 16]
DSA = [21, -14, -3, 10, -5, -9, 8, 3, 9, -19, 17, -13, -3, 17, -2, -11, -3, 9, 3, -2, -3, 6]


def table(spark, *rows_):
    return suffix.columns(suffix.suffix_array(texts(spark, *rows_))).orderBy("doc_id", "i")


def test_golden_array(spark):
    t = table(spark, GOLDEN).collect()
    assert [r.sa for r in t] == SA
    assert "".join(r.bwt or "$" for r in t) == "gssta$ tnTr hitiie s s"
    assert [r.dsa for r in t] == DSA
    assert [r.lf for r in t[:6]] == [8, 15, 16, 19, 6, 0]
    assert t[-1].run == 19


def test_identities(spark):
    t = table(spark, GOLDEN).collect()
    sa = [r.sa for r in t]
    assert all(sa[r.lf] == r.sa - 1 for r in t if r.sa)
    assert [r.phi_inv for r in t] == sa[1:] + sa[:1]


@pytest.mark.parametrize("seed", range(3))
def test_doubling_equals_sorting(spark, seed):
    draw = random.Random(seed)
    t = texts(spark, *(repetitive(draw, draw.randrange(1, 300), "aé"[: 1 + seed % 2] + "b") for _ in range(3)))
    assert rows(suffix.suffix_array_by_doubling(symbols(t), scratch.stored)) == rows(suffix.suffix_array(t).select("doc_id", "i", "sa"))


def test_intervals_and_a_backward_step(spark):
    t = texts(spark, GOLDEN)
    sa = suffix.suffix_array(t, True)
    assert rows(suffix.intervals(sa, patterns(spark, "is", "test", "q"))) == [(0, 0, 11, 12), (0, 1, 20, 20)]
    asked = suffix.intervals(sa, patterns(spark, "est"))
    full = suffix.columns(suffix.suffix_array(t))
    assert rows(suffix.backward_step(asked, full, F.lit("t"))) == [(0, 0, 20, 20)]
    assert rows(suffix.backward_step(asked, full, F.lit("q"))) == []


def test_lcp_ranges_and_reverting(spark):
    t = texts(spark, "banana", "")
    sa = suffix.suffix_array(t, True)
    assert [r.lcp for r in suffix.lcp(sa).where("doc_id = 0").orderBy("i").collect()] == [0, 0, 1, 3, 0, 0, 2]
    assert rows(suffix.reverted(sa)) == rows(t)
    assert rows(suffix.text_range(t, 1, 3)) == [(0, "ana"), (1, "")]
    assert rows(suffix.text_range(t, 1, 0)) == rows(t.select("doc_id", "text"))
    assert suffix.table_range(sa, 1, 2, "sa").count() == 2
    assert rows(suffix.inverse(sa)) == rows(sa.select("doc_id", F.col("sa"), "i"))
    assert suffix.samples(sa, 3).where("doc_id = 0").count() == 3


def test_symbol_counts(spark):
    assert rows(suffix.symbol_counts(symbols(texts(spark, "banana")))) == [("a", 3, 0), ("b", 1, 3), ("n", 2, 4)]


def test_move_structure(spark):
    t = table(spark, GOLDEN, "abababab")
    m = intervals.move_structure(t)
    want = rows(t.select("doc_id", "i", "lf"))
    assert rows(intervals.moved(t.select("doc_id", "i"), m).select("doc_id", "i", "target")) == want
    b = intervals.balanced(m, 2, scratch.stored)
    assert rows(intervals.moved(t.select("doc_id", "i"), b).select("doc_id", "i", "target")) == want
    for doc in (0, 1):
        iv = [r for r in b.collect() if r.doc_id == doc]
        assert max(sum(r.q < x.p < r.q + r.len for x in iv) for r in iv) + 1 < 4
        assert all(next(x.p for x in iv if x.x == r.idx) + r.offs == r.q for r in iv)


def test_rank_select_and_neighbours(spark):
    df = spark.createDataFrame([(0, i, c) for i, c in enumerate("abcab")], "doc_id long, i long, sym string")
    assert [r.rank for r in rank_select.rank(df).orderBy("i").collect()] == [0, 0, 0, 1, 1]
    assert [r.rank for r in rank_select.rank(df, "b").orderBy("i").collect()] == [0, 0, 1, 1, 1]
    assert rows(rank_select.select(df).where("sym = 'b'")) == [(0, "b", 1, 1), (0, "b", 2, 4)]
    assert rows(rank_select.neighbours(df, "b").select("i", "pred", "succ").fillna(-1)) == [(0, -1, 1), (1, 1, 1), (2, 1, 4), (3, 1, 4), (4, 4, 4)]


@pytest.mark.parametrize("text", [GOLDEN, "abcabcabcabc" * 6, "a", ""])
def test_encodings_decode_to_the_array(spark, text):
    t = scratch.stored(table(spark, text))
    want = rows(t.select("doc_id", "i", "sa"))
    ref = compressed.reference_of(t, segment=8, segments=3)
    assert rows(compressed.rlz_decoded(compressed.rlz(t, ref), ref)) == want
    assert rows(compressed.lz_end_decoded(compressed.lz_end(t))) == want


@pytest.mark.parametrize("text", [GOLDEN, "abcabcabcabc" * 6, "a", ""])
def test_ranges_decode_from_their_phrases(spark, text, monkeypatch):
    monkeypatch.setattr(compressed, "PIECE", 4)
    t = scratch.stored(table(spark, text))
    sa = {r.i: r.sa for r in t.collect()}
    ref = scratch.stored(compressed.reference_of(t, segment=8, segments=3))
    phrases = compressed.with_bases(compressed.rlz(t, ref), t)
    n, doc = len(sa), t.first().doc_id
    asked = [(0, 0, n - 1), (1, n - 1, n + 5), (2, n // 2, n // 2), (3, n // 3, n // 2 + 3), (3, 0, 1), (4, n, n + 2), (5, 2, 1)]
    queries = spark.createDataFrame([(q, doc, a, z) for q, a, z in asked], "query long, doc_id long, left long, right long")
    want = sorted((q, doc, i, sa[i]) for q, a, z in asked for i in range(a, z + 1) if i in sa)
    assert rows(compressed.rlz_ranges(phrases, ref, queries)) == want


@pytest.mark.parametrize("text", [GOLDEN, "abcabcabcabc" * 6, "aaaaaaaaa", "a", ""])
def test_lz_end_ranges_and_cursors(spark, text, monkeypatch):
    monkeypatch.setattr(compressed, "PIECE", 4)
    t = scratch.stored(table(spark, text))
    sa = {r.i: r.sa for r in t.collect()}
    n, doc = len(sa), t.first().doc_id
    phrases = compressed.lz_end_with_bases(compressed.lz_end(t), t)
    asked = [(0, 0, n - 1), (1, n - 1, n + 5), (2, n // 2, n // 2), (3, n // 3, n // 2 + 3), (4, n, n + 2), (5, 2, 1)]
    queries = spark.createDataFrame([(q, doc, a, z) for q, a, z in asked], "query long, doc_id long, left long, right long")
    want = sorted((q, doc, i, sa[i]) for q, a, z in asked for i in range(a, z + 1) if i in sa)
    assert rows(compressed.lz_end_ranges(phrases, queries, scratch.stored)) == want
    moves = [(0, 0, False, 0, 3), (1, n - 1, True, 1, 4), (2, n // 2, True, 0, n), (3, n // 2, False, 2, n), (4, 0, True, 1, 2), (5, 0, False, 0, 0)]
    cursors = spark.createDataFrame([(q, doc, *m) for q, *m in moves], "query long, doc_id long, at long, turned boolean, skip long, n long")
    sizes = t.groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    want = sorted((q, doc, i) for q, at, back, skip, k in moves for o in range(k) if (i := at - skip - o if back else at + skip + o) in sa)
    got = compressed.random_access(t, compressed.cursor_ranges(cursors, sizes))
    assert rows(got.select("query", "doc_id", "i")) == want


@pytest.mark.parametrize("text", [GOLDEN, "abcabcabcabc" * 6, "a"])
def test_conversions_give_texts_and_phrases(spark, text):
    t = scratch.stored(table(spark, text))
    doc, runs = t.first().doc_id, suffix.runs(t)
    ref = scratch.stored(compressed.reference_of(t, segment=8, segments=3))
    everything = t.groupBy("doc_id").agg(F.count("*").alias("n")).select(F.lit(0).cast("long").alias("query"), "doc_id", F.lit(0).cast("long").alias("left"), (F.col("n") - 1).alias("right"))
    want = rows(t.select(F.lit(0).cast("long").alias("query"), "doc_id", "i", "sa"))
    plain = compressed.converted(runs, compressed.rlz(t, ref), ref)
    assert rows(plain["texts"].select("doc_id", "text")) == [(doc, text)]
    assert rows(compressed.rlz_ranges(plain["phrases"], plain["reference"], everything)) == want
    plain = compressed.converted(runs, compressed.lz_end(t))
    assert rows(plain["texts"].select("doc_id", "text")) == [(doc, text)]
    assert rows(compressed.lz_end_ranges(plain["phrases"], everything, scratch.stored)) == want
    seen = compressed.inspected(runs).first()
    assert (seen.n_rows, seen.n_runs) == (len(text) + 1, runs.count())
    for made in (compressed.rlz(t, ref), compressed.lz_end(t)):
        assert made.agg(F.sum("len")).first()[0] == len(text) + 1 and compressed.phrase_lengths(made).first().n_phrases == made.count()


def test_sequence_of_a_position(spark):
    seqs = intervals.collection(texts(spark, "abc", "", "de"))
    assert rows(seqs) == [(0, 1, 3), (1, 5, 0), (2, 6, 2)]
    at = spark.createDataFrame([(p,) for p in range(9)], "pos long")
    got = {r.pos: (r.seq_id, r.local) for r in intervals.sequence_of(at, seqs).collect()}
    none = (None, None)
    assert got == {0: none, 1: (0, 0), 2: (0, 1), 3: (0, 2), 4: none, 5: none, 6: (2, 0), 7: (2, 1), 8: none}


def test_as_of_carries_over_slices(spark):
    starts = spark.createDataFrame([(5, "a"), ((1 << 21) + 3, "b")], "start long, name string")
    asks = spark.createDataFrame([(p,) for p in (4, 5, 1 << 20, (1 << 21) + 2, (1 << 21) + 3, 1 << 23)], "pos long")
    got = [r.name for r in intervals.as_of(asks, starts, "pos", "start", ["name"]).orderBy("pos").collect()]
    assert got == [None, "a", "a", "a", "b", "b"]


def test_interval_text(spark):
    df = spark.createDataFrame([("(0,1),(1,0)",)], "t string").select(intervals.parse_intervals(F.col("t")).alias("v"))
    assert [(r.p, r.q) for r in df.first().v] == [(0, 1), (1, 0)]
