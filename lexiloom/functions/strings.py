"""Scalar functions over strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(s: Column) -> Column:
    """Reversed, with A and T, C and G exchanged in either case; other symbols stay."""
    return F.translate(F.reverse(s), "ACGTacgt", "TGCAtgca")


def normalised_bases(s: Column, allowed: str = "ACGT", mask: str = "N", to_upper: bool = True) -> Column:
    """A sequence body with carriage returns dropped, raised, and all but ``allowed`` masked."""
    s = F.translate(s, "\r", "")
    if to_upper:
        s = F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.regexp_replace(s, f"[^{allowed}]", mask)


def hamming(a: Column, b: Column) -> Column:
    """Positions at which strings of equal length differ; null for unequal lengths."""
    differ = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    return F.when(F.char_length(a) == F.char_length(b), differ)


def hamming_bounded(a: Column, b: Column, k: int) -> Column:
    """The Hamming distance, ``k + 1`` for anything above ``k``."""
    return F.least(hamming(a, b), F.lit(k + 1))


def edit_bounded(a: Column, b: Column, k: int) -> Column:
    """The edit distance, ``k + 1`` for anything above ``k``."""
    found = F.levenshtein(a, b, k)
    return F.when(found < 0, F.lit(k + 1)).otherwise(found)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y) & (x != ""))
    return _until_false(pairs)


def lex_less(a: Column, b: Column) -> Column:
    """True where ``a`` sorts before ``b``, by code points; a prefix sorts before what it begins."""
    return a < b


def _until_false(flags: Column) -> Column:
    at = F.array_position(flags, F.lit(False))
    return F.when(at == 0, F.size(flags)).otherwise(at - 1).cast("int")


def value_of(header: Column, key: str) -> Column:
    """The value after ``key=`` in a header line, up to a blank."""
    return F.regexp_extract(header, rf"(?:^|\s){key}=(\S*)", 1)


def has_any(s: Column, forbidden: str) -> Column:
    """True where the string holds one of the forbidden characters."""
    return F.translate(s, forbidden, "") != s if forbidden else F.lit(False)
