"""Rank, select, predecessor and successor over (doc_id, i, sym), for all rows at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank(rows: DataFrame, symbol: str | None = None) -> DataFrame:
    """(doc_id, i, sym, rank): symbols equal to the row's own (or to ``symbol``) before row i."""
    if symbol is None:
        place = F.row_number().over(Window.partitionBy("doc_id", "sym").orderBy("i")) - 1
    else:
        order = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
        place = F.count(F.when(F.col("sym") == symbol, 1)).over(order)
    return rows.select("doc_id", "i", "sym", place.cast("long").alias("rank"))


def select(rows: DataFrame) -> DataFrame:
    """(doc_id, sym, k, i): where the k-th occurrence (from 1) of each symbol is."""
    k = F.row_number().over(Window.partitionBy("doc_id", "sym").orderBy("i")).cast("long")
    return rows.select("doc_id", "sym", k.alias("k"), "i")


def neighbours(rows: DataFrame, symbol: str) -> DataFrame:
    """(doc_id, i, pred, succ): the nearest row with ``symbol`` at or before i, and at or after it."""
    at = F.when(F.col("sym") == symbol, F.col("i"))
    order = Window.partitionBy("doc_id").orderBy("i")
    before = F.last(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return rows.select("doc_id", "i", before.alias("pred"), after.alias("succ"))
