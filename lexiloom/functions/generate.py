"""Seeded test inputs: repetitive texts, mutated patterns, pattern samples of a collection."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.strings import has_any

#: Starts drawn for each pattern asked for, at most.
DRAWS = 2048
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def log_uniform(draw: random.Random, low: int, high: int) -> int:
    """A size whose logarithm is uniform."""
    return min(high, int(math.exp(draw.uniform(math.log(low), math.log(high + 1)))))


def alphanumeric(draw: random.Random, n: int) -> str:
    return "".join(draw.choice(LETTERS) for _ in range(n))


def repetitive(draw: random.Random, n: int, alphabet: str = "acgt") -> str:
    """New symbols, copies of what is there and runs, mixed."""
    out = draw.choice(alphabet)
    while len(out) < n:
        kind = draw.random()
        if kind < 0.3:
            out += draw.choice(alphabet)
        elif kind < 0.8:
            at = draw.randrange(len(out))
            out += out[at : at + log_uniform(draw, 1, 40)]
        else:
            out += draw.choice(alphabet) * log_uniform(draw, 1, 12)
    return out[:n]


def mutated(draw: random.Random, pattern: str, edits: int, alphabet: str = "acgt") -> str:
    """``edits`` random substitutions, insertions and deletions."""
    for _ in range(edits):
        at = draw.randrange(len(pattern) + 1)
        kind = draw.choice("sid")
        if kind == "i":
            pattern = pattern[:at] + draw.choice(alphabet) + pattern[at:]
        elif pattern:
            at = min(at, len(pattern) - 1)
            pattern = pattern[:at] + (draw.choice(alphabet) if kind == "s" else "") + pattern[at + 1 :]
    return pattern


def sample_patterns(texts: DataFrame, n: int, length: int, seed: int = 42, forbidden: str = "") -> DataFrame:
    """(pat_id, pattern): ``n`` substrings of a length at seeded random starts, none with a forbidden character.

    Every text offers starts in proportion to its length; more are drawn than are needed, those
    with forbidden characters let go, and if too few are left more are drawn.  Raises ValueError
    where DRAWS times as many starts do not give ``n``.  The last start of a text is never drawn.
    """
    room = F.char_length("text") - length
    total = texts.agg(F.sum(F.greatest(room, F.lit(0)))).first()[0] or 0
    if not total:
        return texts.sparkSession.createDataFrame([], "pat_id long, pattern string")
    factor, rows = 4, []
    while len(rows) < n:
        if factor > DRAWS:
            raise ValueError(f"{len(rows)} of {n} patterns without a forbidden character were found")
        share = factor * n / total
        starts = texts.where(room > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.ceil(room * share).cast("int"))).alias("k"), room.alias("room"))
        at = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "k"), F.col("room")).cast("int")
        drawn = starts.select("doc_id", "k", F.substring("text", at + 1, F.lit(length)).alias("pattern")).where(~has_any(F.col("pattern"), forbidden))
        drawn = drawn.orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "k"), "doc_id", "k").limit(n)
        rows = [(i, r.pattern) for i, r in enumerate(drawn.select("pattern").collect())]  # n rows, a parameter
        factor *= 8
    return texts.sparkSession.createDataFrame(rows, "pat_id long, pattern string")


def extension_plan(m: int, seed: int) -> list[str]:
    """A start and a random order of left and right steps that build a pattern of length m."""
    draw = random.Random(seed)
    left = draw.randrange(m)
    steps = ["left"] * left + ["right"] * (m - 1 - left)
    draw.shuffle(steps)
    return steps
