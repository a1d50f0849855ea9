"""Search schemes: how the errors of a match may be spread over the parts of a pattern.

A search visits the parts in an order and bounds the errors seen so far after each.  A
scheme is complete if every way to spread at most k errors passes one of its searches;
``uncovered`` tells.  The joins of ``operators.approximate`` take their seeds from a scheme:
what a search visits before it allows an error is one stretch of the pattern, found exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Step:
    part: int
    low: int
    high: int


@dataclass(frozen=True)
class Scheme:
    k: int
    parts: int
    searches: tuple[tuple[Step, ...], ...]

    def uncovered(self) -> list[tuple[int, ...]]:
        """Spreads of at most k errors that no search admits."""
        out: list[tuple[int, ...]] = []
        for spreads in _spreads(self.parts, self.k):
            open_ = np.ones(len(spreads), bool)
            for steps in self.searches:
                sums = np.cumsum(spreads[:, [s.part for s in steps]], axis=1)
                open_ &= ~((sums >= [s.low for s in steps]) & (sums <= [s.high for s in steps])).all(axis=1)
            out += map(tuple, spreads[open_].tolist())
        return out

    def seeds(self) -> list[tuple[int, int]]:
        """(first part, last part + 1) of stretches of which one is free of errors: what each search
        finds before it allows an error, or k + 1 of the parts if some search allows one at once."""
        found = set()
        for steps in self.searches:
            exact = [s.part for s in steps[: next((n for n, s in enumerate(steps) if s.high), len(steps))]]
            if not exact or max(exact) - min(exact) >= len(exact):
                if self.parts <= self.k:
                    raise ValueError(f"{self.parts} parts may all hold one of {self.k} errors")
                return [(p, p + 1) for p in range(self.k + 1)]
            found.add((min(exact), max(exact) + 1))
        return sorted(found)

    def text(self) -> str:
        """The file form: a header, then {order} {lower bounds} {upper bounds} a line."""
        lines = [" ".join("{" + ",".join(str(getattr(s, f)) for s in steps) + "}" for f in ("part", "low", "high")) for steps in self.searches]
        return "\n".join([f"p={self.parts} k={self.k}", *lines]) + "\n"


def _spreads(parts: int, k: int, at_once: int = 8) -> Iterator[np.ndarray]:
    """All ways to spread at most k errors over the parts, a row each; blocks by the first parts' errors."""

    def grown(rows: np.ndarray, n: int) -> np.ndarray:
        for _ in range(n):
            room = k - rows.sum(axis=1)
            rows = np.hstack([np.repeat(rows, room + 1, axis=0), np.concatenate([np.arange(r + 1) for r in room])[:, None]])
        return rows

    heads = grown(np.zeros((1, 0), np.int64), max(0, parts - at_once))
    for head in heads:
        yield grown(head[None, :], min(parts, at_once))


def outward(start: int, parts: int) -> list[int]:
    """From a part to the right end, then to the left one."""
    return [*range(start, parts), *range(start - 1, -1, -1)]


def _scheme(k: int, parts: int, starts, high) -> Scheme:
    searches = tuple(tuple(Step(p, 0, high(i, n, p)) for n, p in enumerate(outward(i, parts))) for i in starts)
    return Scheme(k, parts, searches)


def pigeonhole(k: int) -> Scheme:
    """k + 1 parts; each in turn is free of errors."""
    return _scheme(k, k + 1, range(k + 1), lambda i, n, p: 0 if n == 0 else k)


def suffix_filter(k: int) -> Scheme:
    """k + 1 parts; to the right of the start an error more a part, at most."""
    return _scheme(k, k + 1, range(k + 1), lambda i, n, p: p - i if p >= i else k)


def zero_one(k: int) -> Scheme:
    """k + 2 parts; a part without error, then one with at most one (none in the last search)."""

    def high(i: int, n: int, p: int) -> int:
        return (0, int(i < k))[n] if n < 2 else k

    return _scheme(k, k + 2, range(k + 1), high)


def first_exact(k: int) -> Scheme:
    """k + 1 parts; search i is for spreads whose first part without error is i.

    The i parts to its left have an error each, so the parts to its right share k - i at most,
    and every part visited on the left raises the lower bound by one: no spread passes two
    searches, for any k.
    """
    searches = []
    for i in range(k + 1):
        right = [Step(p, 0, k - i if n else 0) for n, p in enumerate(range(i, k + 1))]
        left = [Step(i - n, n, k - i + n) for n in range(1, i + 1)]
        searches.append((*right, *left))
    return Scheme(k, k + 1, tuple(searches))


FAMILIES = {"pigeonhole": pigeonhole, "suffix_filter": suffix_filter, "zero_one": zero_one, "first_exact": first_exact}


def parse(text: str) -> Scheme:
    """A scheme from its file form; raises ValueError where it is malformed or incomplete."""
    header, *lines = text.splitlines() or [""]
    named = dict(re.findall(r"(\w+)=(\d+)", header))
    if not {"p", "k"} <= named.keys():
        raise ValueError("a search scheme begins with p=.. k=..")
    parts, k, searches = int(named["p"]), int(named["k"]), []
    for line in lines:
        if "{" not in line:
            continue
        order, low, high = ([int(x) for x in b.replace(",", " ").split()] for b in re.findall(r"\{([^}]*)\}", line)[:3])
        if not len(order) == len(low) == len(high) == parts or sorted(order) != list(range(parts)):
            raise ValueError(f"not a search over {parts} parts: {line}")
        searches.append(tuple(map(Step, order, low, high)))
    scheme = Scheme(k, parts, tuple(searches))
    if left := scheme.uncovered():
        raise ValueError(f"errors spread as {left[0]} pass no search")
    return scheme


def load(path: str) -> Scheme:
    with open(path, encoding="ascii") as f:
        return parse(f.read())


def part_starts(m: int, parts: int) -> list[int]:
    """Where the parts of a pattern of length m begin, and its end."""
    return [p * m // parts for p in range(parts + 1)]
