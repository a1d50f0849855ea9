from __future__ import annotations

import itertools
import random

import pytest

from lexiloom.functions import alignment as A
from lexiloom.functions.generate import mutated, repetitive
from lexiloom.operators import approximate
from lexiloom.plans import schemes
from tests.test_exact import patterns, rows, texts


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def naive_edit(t, p, k):
    out = []
    for i in range(len(t)):
        best = min(((distance(p, t[i : i + n]), n) for n in range(max(1, len(p) - k), min(len(p) + k, len(t) - i) + 1)), default=(k + 1, 0))
        if best[0] <= k:
            out.append((i, best[1], best[0]))
    return out


def naive_hamming(t, p, k):
    ds = ((i, sum(x != y for x, y in zip(p, t[i : i + len(p)], strict=True))) for i in range(len(t) - len(p) + 1))
    return [(i, len(p), d) for i, d in ds if d <= k]


def inputs(seed):
    draw = random.Random(seed)
    t = [repetitive(draw, draw.randrange(1, 500), "acgté" if seed % 2 else "ab") for _ in range(3)]
    p = []
    while len(p) < 6:
        s = draw.choice(t)
        at = draw.randrange(len(s))
        q = mutated(draw, s[at : at + draw.randrange(6, 24)], draw.randrange(3))
        if len(q) > 4:
            p.append(q)
    return t, p


@pytest.mark.parametrize("seed", range(4))
def test_hamming_equals_the_naive_scan(spark, seed):
    t, p = inputs(seed)
    want = sorted((d, i, *hit) for d, s in enumerate(t) for i, q in enumerate(p) for hit in naive_hamming(s, q, 2))
    assert rows(approximate.locate_hamming(texts(spark, *t), patterns(spark, *p), 2)) == want


@pytest.mark.parametrize("seed", range(4))
def test_edit_equals_the_naive_scan(spark, seed):
    t, p = inputs(seed)
    want = sorted((d, i, *hit) for d, s in enumerate(t) for i, q in enumerate(p) for hit in naive_edit(s, q, 2))
    found = approximate.locate_edit(texts(spark, *t), patterns(spark, *p), 2)
    assert rows(found) == want
    kept = approximate.without_redundant(found, 2)
    assert kept.count() <= len(want)
    assert approximate.not_covered(found, kept, 2).isEmpty()


def test_goldens(spark):
    t = texts(spark, "This is a test string")
    assert [r[2:] for r in rows(approximate.locate_hamming(t, patterns(spark, "test"), 1))] == [(10, 4, 0), (13, 4, 1)]
    assert [r[2:] for r in rows(approximate.locate_edit(t, patterns(spark, "best"), 1))] == [(10, 4, 1), (11, 3, 1)]


@pytest.mark.parametrize("metric", ["hamming", "edit"])
def test_patterns_of_any_length_beside_one_another(spark, metric):
    t, p = ["abcabdabcxyabe", "zz", ""], ["abc", "abcabd", "a", "zq", "ab"]
    naive = naive_hamming if metric == "hamming" else naive_edit
    want = sorted((d, i, *hit) for d, s in enumerate(t) for i, q in enumerate(p) for hit in naive(s, q, 2) if hit[1])
    assert rows(approximate.locate(texts(spark, *t), patterns(spark, *p), 2, metric)) == want


@pytest.mark.parametrize("family", schemes.FAMILIES)
def test_answers_do_not_depend_on_the_scheme(spark, family):
    t, p = inputs(7)
    want = sorted((d, i, *hit) for d, s in enumerate(t) for i, q in enumerate(p) for hit in naive_hamming(s, q, 2))
    assert rows(approximate.locate_hamming(texts(spark, *t), patterns(spark, *p), 2, schemes.FAMILIES[family](2))) == want


def test_seeds_are_what_a_search_finds_before_it_allows_an_error():
    assert schemes.pigeonhole(2).seeds() == [(0, 1), (1, 2), (2, 3)]
    assert schemes.parse("p=4 k=2\n{0,1,2,3} {0,0,0,0} {0,1,1,2}\n{3,2,1,0} {0,0,0,0} {0,1,2,2}\n{1,2,3,0} {0,0,0,1} {0,0,1,2}\n{0,1,2,3} {0,0,0,2} {0,0,2,2}\n").seeds() == [
        (0, 1), (0, 2), (1, 3), (3, 4),
    ]


def test_completeness_is_told_for_many_errors():
    assert schemes.first_exact(10).uncovered() == []
    assert schemes.zero_one(9).uncovered() == []
    cut = schemes.pigeonhole(9)
    assert schemes.Scheme(9, 10, cut.searches[1:]).uncovered()


def test_counts_and_the_shortcut_for_short_patterns(spark):
    t, p = texts(spark, "aaaa", "abab"), patterns(spark, "aab", "a")
    assert rows(approximate.histogram_hamming(t, p, 1)) == [(0, 0, 3), (1, 8, 0)]
    assert rows(approximate.count_hamming(t, p, 1)) == [(0, 3), (1, 8)]


@pytest.mark.parametrize(
    ("hits", "kept"),
    [
        ([(9, 5, 0), (10, 4, 1), (11, 3, 1)], [(9, 5, 0), (11, 3, 1)]),
        ([(9, 5, 1), (10, 4, 0), (11, 3, 1)], [(9, 5, 1), (10, 4, 0), (11, 3, 1)]),
        ([(0, 4, 0), (3, 4, 1), (6, 4, 0)], [(0, 4, 0), (3, 4, 1), (6, 4, 0)]),
        ([(0, 4, 1)], [(0, 4, 1)]),
    ],
)
def test_redundant_hits(spark, hits, kept):
    df = spark.createDataFrame([(0, 0, *h) for h in hits], "doc_id long, pat_id long, pos long, len int, err int")
    assert [r[2:] for r in rows(approximate.without_redundant(df, 1))] == kept


def test_effective_intervals(spark):
    df = spark.createDataFrame([(0, 9, 5, 1), (2, 4, 6, 0), (3, 3, 8, 0)], "b long, e long, len int, err int")
    got = {r.i: (r.len, r.err) for r in approximate.effective_intervals(df).collect()}
    assert got == {i: (8, 0) if i == 3 else (6, 0) if 2 <= i <= 4 else (5, 1) for i in range(10)}


def test_scripts_and_their_spellings():
    runs = [("=", 5, None), ("X", 1, "G"), ("I", 1, "A"), ("I", 1, "C"), ("=", 3, None)]
    assert A.cigar(runs) == "5=1X2I3="
    assert A.md([("=", 10, None), ("X", 1, "G"), ("=", 5, None), ("D", 1, "T"), ("D", 1, "A"), ("=", 6, None)]) == "10G5^TA6"
    assert A.script_edits("AB", "AC", [("=", 2, None)]) == -1
    assert A.edit_script("abc", "xyz", 1) == (2, [])
    assert A.prefix_script("", "abc", 1) == (0, 0, [])


@pytest.mark.parametrize("seed", range(30))
def test_scripts_turn_patterns_into_texts(seed):
    draw = random.Random(seed)
    a = repetitive(draw, draw.randrange(1, 20))
    b = mutated(draw, a, draw.randrange(4))
    d = distance(a, b)
    err, runs = A.edit_script(a, b, 5)
    assert err == min(d, 6)
    if d <= 5:
        assert A.script_edits(a, b, runs) == d
    err, n, runs = A.prefix_script(a, b + "tt", 4)
    best = min((distance(a, (b + "tt")[:j]), j) for j in range(len(b) + 3))
    assert (err, n) == (best if best[0] <= 4 else (5, 0))


@pytest.mark.parametrize(("family", "k"), [*itertools.product(schemes.FAMILIES, range(4))])
def test_schemes_are_complete(family, k):
    made = schemes.FAMILIES[family](k)
    assert made.uncovered() == []
    assert schemes.parse(made.text()) == made


def test_incomplete_and_malformed_schemes_are_refused():
    with pytest.raises(ValueError, match="pass no search"):
        schemes.parse("p=2 k=1\n{0,1} {0,0} {0,1}\n")
    with pytest.raises(ValueError, match="begins with"):
        schemes.parse("")
    with pytest.raises(ValueError, match="not a search"):
        schemes.parse("p=2 k=1\n{0,5} {0,0} {0,1}\n")


def test_part_starts():
    assert schemes.part_starts(10, 3) == [0, 3, 6, 10]
