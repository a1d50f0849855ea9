from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import approximate
from lexiloom.plans import grid
from lexiloom.sources import scratch
from tests.test_exact import texts


def test_cells_are_chosen():
    assert len(grid.cells()) == 2 * (8 + 8 + 7 + 7) + 16 + 13
    assert grid.cells([4], [4, 10], ["edit"], ["match"]) == [("match", "edit", 4, 10)]
    assert {c.kind for c in grid.cells(kinds=["extend", "balance"])} == {"extend", "balance"}


def test_cells_are_run(spark):
    df = texts(spark, "abracadabra" * 4, "abrakadabra" * 3)
    chosen = grid.cells([1], [5], ["hamming"], balances=[2, 4])
    got = list(grid.run(df, chosen, 3, 7, scratch.stored))
    assert [r["kind"] for r in got] == ["match", "extend", "extend", "balance", "balance"]
    assert all(r["found"] > 0 and r["seconds"] is not None for r in got)
    patterns = scratch.stored(grid.sample_patterns(df, 3, 5, 7))
    assert got[0]["found"] == approximate.locate_hamming(df, patterns, 1).count() and got[0]["patterns"] == 3
    assert got[3]["found"] >= got[4]["found"]  # a larger parameter cuts less


def test_slow_cells_are_left_out(spark):
    df = texts(spark, "abracadabra" * 4)
    got = list(grid.run(df, grid.cells([1, 2], [5, 6], ["hamming"], ["match"]), 3, 7, scratch.stored, budget=0))
    assert [(r["k"], r["m"], r["seconds"] is None) for r in got] == [(1, 5, False), (1, 6, False), (2, 5, True), (2, 6, True)]
    assert df.agg(F.count("*")).first()[0] == 1
