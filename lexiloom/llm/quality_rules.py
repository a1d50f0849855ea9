"""Quality rules as a ledger of failure bits (DataFrame functions only).

``ledger`` measures every text once and stores, beside the measurements, one
``long`` whose bit *i* says that rule *i* failed.  ``apply_policy`` decides with a
versioned set of rules by one bitwise AND, and ``ablation`` tells from the stored
bits alone what each rule of a policy removes, so neither reads a text again.

Defined results: a null or blank text has no words and fails ``too_few_words``;
repeated rows are measured each by itself; other columns pass through unless they
bear the name of a measurement, which then replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import WORD, let, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_caps_words", "n_exclaims")

#: Rules in the order of their bits; each is true where a text fails.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_phrases": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "shouting": "10 * n_caps_words > 3 * n_words",
    "exclaiming": "10 * n_exclaims > 3 * n_words",
    "odd_word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A named version of the set of rules that reject a text."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return reduce(lambda bits, r: bits | bit(r), self.rules, 0)


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


BASE = Policy("base", ("too_few_words", "repeated_phrases"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", tuple(RULES)))}


def repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the array ``ws``.

    Windows are compared by a 64-bit hash.  Arrays whose windows all differ, nearly
    all of them, stop at a primitive distinct; only the rest sort their windows.
    """

    def covered(h: Column) -> Column:
        windows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(
            windows,
            lambda s: F.transform(
                F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])),
                lambda x: x["i"],
            ),
        )
        steps = let(
            F.sort_array(twice),
            lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def hashed(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return let(ws, lambda w: let(hashed(w), count)).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements in place of columns of those names."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    of_words = let(
        words(F.col(text)),
        lambda w: F.struct(
            F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeat_words(w).alias("repeats")
        ),
    )
    rest = [c for c in docs.columns if c not in MEASURES]
    made = docs.select(*rest, of_words.alias("_w"), of_lines.alias("_l"), F.regexp_count(t, F.lit("[#*$%&|<>]")).alias("_s"), F.regexp_count(t, F.lit(r"\b\p{Lu}{2,}\b")).alias("_c"), F.regexp_count(t, F.lit("!")).alias("_e"))
    found = {
        "n_words": "_w.n", "word_chars": "_w.chars", "n_symbols": "_s", "n_lines": "_l.n", "n_dup_lines": "_l.dup",
        "n_repeat_words": "_w.repeats", "n_caps_words": "_c", "n_exclaims": "_e",
    }
    return made.select(*rest, *(F.col(found[m]).cast("long").alias(m) for m in MEASURES))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``measured`` plus ``failed_bits``: every rule evaluated once, kept for good."""
    bits = reduce(Column.bitwiseOR, (F.when(F.expr(sql), F.lit(bit(r)).cast("long")).otherwise(F.lit(0).cast("long")) for r, sql in RULES.items()))
    return measured(docs.drop("failed_bits"), text).withColumn("failed_bits", bits)


def apply_policy(rows: DataFrame, policy: Policy, out: str = "kept") -> DataFrame:
    """Adds ``out``: no rule of the policy failed."""
    return rows.withColumn(out, F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule: texts that fail it, and those that only it removes.

    One aggregation over the distinct bit patterns, at most ``2 ** len(RULES)`` rows.
    """
    patterns = rows.select(F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("b")).groupBy("b").count()
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in policy.rules)))
    return (
        patterns.select("b", "count", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("b").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_only"),
        )
        .withColumn("policy", F.lit(policy.version))
    )
