"""Timed grids: approximate matching by errors and length, extensions by length, balancing by parameter.

A cell is a set of patterns of one length, drawn from the texts with a seed, and one search
over all texts, run to its count.  Cells come as rows of plain values, one line of JSON each.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.generate import sample_patterns
from lexiloom.operators import approximate, exact, intervals, suffix

# The grids' errors, lengths and balancing parameters.
ERRORS = (4, 7, 10, 13)
LENGTHS = (10, 20, 40, 80, 160, 320, 640, 1280)
BALANCES = (2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192)

KINDS = ("match", "extend", "balance")


class Cell(NamedTuple):
    kind: str
    metric: str
    k: int
    m: int


def cells(ks=ERRORS, ms=LENGTHS, metrics=("hamming", "edit"), kinds=KINDS, balances=BALANCES) -> list[Cell]:
    """The chosen part of the grid, in order; lengths of k or less have no cell."""
    out = [Cell("match", metric, k, m) for metric in metrics for k in ks for m in ms if m > k]
    out += [Cell("extend", side, 0, m) for side in ("left", "right") for m in ms]
    out += [Cell("balance", "", 0, a) for a in balances]
    return [c for c in out if c.kind in kinds]


def run(texts: DataFrame, chosen: list[Cell], n: int, seed: int, stored: Callable[[DataFrame], DataFrame], budget: float = float("inf")) -> Iterator[dict]:
    """One row a cell: patterns, results and seconds.

    Once a search has taken more than ``budget`` seconds, the same search with as many errors or
    more and patterns of that length or shorter is left out, with ``seconds`` null: it is taken to be no faster.
    """
    structure, slow = None, []
    sets: dict[int, DataFrame] = {}
    for cell in chosen:
        row = cell._asdict()
        if any(c[:2] == cell[:2] and cell.kind == "match" and cell.k >= c.k and cell.m <= c.m for c in slow):
            yield row | {"patterns": None, "found": None, "seconds": None}
            continue
        if cell.kind == "balance":
            structure = structure or stored(intervals.move_structure(suffix.columns(suffix.suffix_array(texts))))
            job, size = (lambda a=cell.m: intervals.balanced(structure, a, stored)), 0
        else:
            if cell.m not in sets:
                sets[cell.m] = stored(sample_patterns(texts, n, cell.m, seed))
            patterns = sets[cell.m]
            size = patterns.count()
            if cell.kind == "match":
                job = lambda c=cell, p=patterns: approximate.locate(texts, p, c.k, c.metric)
            else:
                job = lambda c=cell, p=patterns: exact.extensions(texts, p, c.metric)
        began = time.monotonic()
        found = job().agg(F.count("*")).first()[0]
        seconds = time.monotonic() - began
        if seconds > budget:
            slow.append(cell)
        yield row | {"patterns": size, "found": found, "seconds": round(seconds, 3)}
