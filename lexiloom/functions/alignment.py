"""Alignments of a pattern with a text: distances, edit scripts, their SAM spellings.

The dynamic programme is banded; over many pairs it runs as numpy operations on a whole
batch at a time.  An edit script is a list of runs (op, length, symbol): ``=`` of any length
without symbol; ``X`` and ``D`` of one with the text's symbol, ``I`` of one with the pattern's.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

RUNS = "array<struct<op: string, len: int, sym: string>>"
Run = tuple[str, int, str | None]


def best_prefixes(patterns: list[str], texts: list[str], k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the smallest edit distance of the pattern to a prefix of the text, and
    the shortest such prefix of at least ``least`` characters; k + 1 and 0 beyond k."""
    err, length = np.full(len(patterns), k + 1, np.int32), np.zeros(len(patterns), np.int32)
    by_m: dict[int, list[int]] = {}
    for i, p in enumerate(patterns):
        by_m.setdefault(len(p), []).append(i)
    for m, at in by_m.items():
        p = np.array([[ord(c) for c in patterns[i]] for i in at], np.int32).reshape(len(at), m)
        width = m + k
        t = np.full((len(at), width + 1), -1, np.int32)
        for r, i in enumerate(at):
            w = [ord(c) for c in texts[i][:width]]
            t[r, 1 : len(w) + 1] = w
        n = np.array([min(len(texts[i]), width) for i in at])
        band = 2 * k + 1  # column j of row i is at j - i + k
        big = 2 * (m + k) + 2
        row = np.full((len(at), band), big, np.int32)
        for j in range(0, k + 1):
            row[:, j + k] = j
        for i in range(1, m + 1):
            new = np.full_like(row, big)
            for b in range(band):
                j = i + b - k
                if j < 0 or j > width:
                    continue
                best = np.full(len(at), big, np.int32)
                if j > 0:
                    best = row[:, b] + (p[:, i - 1] != t[:, j])
                if b + 1 < band:
                    best = np.minimum(best, row[:, b + 1] + 1)
                if b > 0 and j > 0:
                    best = np.minimum(best, new[:, b - 1] + 1)
                new[:, b] = best
            row = new
        for b in range(band):
            j = m + b - k
            if j < max(least, m - k):
                continue
            e = np.where(j <= n, row[:, b], k + 1)
            better = e < err[at]
            idx = np.array(at)[better]
            err[idx], length[idx] = e[better], j
    return err, length


def starts_within(codes: np.ndarray, pattern: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in ``codes`` of windows within k edits of a pattern of more than k symbols, and for each
    the smallest distance and the shortest length of a window that has it.

    -1 is in no pattern: k + 1 of them keep texts apart.  The programme runs from the end, a row for
    each symbol of the pattern over all places at once; a cell holds distance * unit + length, so that
    its minimum is the shortest window of smallest distance.
    """
    m, n = len(pattern), len(codes)
    unit = m + k + 1
    none = (k + 1) * unit
    most = none + 2 * unit + 1
    kind = np.uint8 if most < 256 else np.uint16 if most < 65536 else np.int64
    turned = codes[::-1]
    costs = {c: np.where(turned == c, 1, 1 + unit).astype(kind) for c in set(pattern.tolist())}
    row, new, more = np.zeros(n + 1, kind), np.empty(n + 1, kind), np.empty(n, kind)
    for c in pattern[::-1].tolist():
        np.add(row, unit, out=new)
        np.add(row[:-1], costs[c], out=more)
        np.minimum(new[1:], more, out=new[1:])
        for _ in range(k):  # more symbols of the text, one error each
            np.add(new[:-1], unit + 1, out=more)
            np.minimum(new[1:], more, out=new[1:])
        np.minimum(new, none, out=new)
        row, new = new, row
    at = np.flatnonzero(row[1:] < none) + 1
    at = at[turned[at - 1] >= 0][::-1]
    found = row[at].astype(np.int64)
    return n - at, found // unit, found % unit


#: Symbols that ``scanned`` takes at a time: its arrays stay in the processor's cache.
BLOCK = 1 << 16


def scanned(texts: list[str], patterns: list[str], k: int) -> list[np.ndarray]:
    """For each text an array of rows (pattern's number, start, length, distance), as ``starts_within`` has them."""
    gap = np.full(k + 1, -1, np.int32)
    parts = [x for t in texts for x in (np.frombuffer(t.encode("utf-32-le"), np.int32), gap)]
    firsts = np.cumsum([0, *(len(t) + k + 1 for t in texts)])[:-1]
    codes = np.concatenate([*parts, gap])
    sought = [np.frombuffer(p.encode("utf-32-le"), np.int32) for p in patterns]
    reach = max(map(len, sought), default=0) + k
    rows = []
    for low in range(0, len(codes), BLOCK):
        block = codes[low : low + BLOCK + reach]
        for i, p in enumerate(sought):
            at, err, length = starts_within(block, p, k)
            own = at < BLOCK
            rows.append(np.stack([np.full(own.sum(), i), at[own] + low, length[own], err[own]], axis=1))
    found = np.concatenate(rows) if rows else np.zeros((0, 4), np.int64)
    text = np.searchsorted(firsts, found[:, 1], side="right") - 1
    order = np.argsort(text, kind="stable")
    found, text = found[order], text[order]
    found[:, 1] -= firsts[text]
    return np.split(found, np.searchsorted(text, np.arange(1, len(texts))))


def not_redundant(positions: list[int], errors: list[int], k: int) -> list[int]:
    """The hits of one pattern in one text, by position, that ``approximate.without_redundant`` keeps."""
    kept: list = []
    for i, (pos, err) in enumerate(zip(positions, errors, strict=True)):
        while len(kept) >= 2 and pos - kept[-2][1] <= 2 * k + 3 and kept[-2][2] <= kept[-1][2] and err <= kept[-1][2]:
            kept.pop()
        kept.append((i, pos, err))
    return [i for i, _, _ in kept]


def edit_scan(k: int, filtered: bool):
    """Column function (text, patterns as a JSON list): struct of arrays, one element for each start in the text
    of a window within k edits of a pattern of more than k characters: its number, ..., the window.

    ``filtered``: without redundant hits, all of a pattern in a text being there.
    """

    @F.pandas_udf("struct<i: array<int>, pos: array<int>, len: array<int>, err: array<int>, w: array<string>>")
    def run(text: pd.Series, patterns: pd.Series) -> pd.DataFrame:
        out: list = [None] * len(text)
        for block, same in text.reset_index(drop=True).groupby(patterns.reset_index(drop=True)):
            texts = list(same)
            for n, t, rows in zip(same.index, texts, scanned(texts, json.loads(block), k), strict=True):
                rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
                if filtered:
                    cuts = np.flatnonzero(np.diff(rows[:, 0], prepend=-1, append=-1))
                    own = [rows[a:b] for a, b in itertools.pairwise(cuts.tolist())]
                    rows = np.concatenate([x[not_redundant(x[:, 1].tolist(), x[:, 3].tolist(), k)] for x in own] or [rows])
                i, pos, length, err = rows.astype(np.int32).T.copy()
                out[n] = (i, pos, length, err, [t[a:b] for a, b in zip(pos.tolist(), (pos + length).tolist(), strict=True)])
        return pd.DataFrame(out, columns=["i", "pos", "len", "err", "w"])

    return run


#: Base of the hashes of stretches (odd, so that it has an inverse) and a factor that mixes their bits.
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


class Seeds:
    """Stretches of patterns, each of ``q`` symbols at least, to be met in texts.

    Hashes of q symbols choose the stretches, hashes of whole ones confirm them; a stretch that is
    met by chance costs a comparison, none is lost.
    """

    def __init__(self, patterns: list[np.ndarray], stretches: list[list[tuple[int, int]]], q: int):
        self.q, self.longest = q, max((b - a for own in stretches for a, b in own), default=q)
        n = BLOCK + self.longest
        self.up, self.down = np.ones(n, np.uint64), np.ones(n, np.uint64)
        self.up[1:], self.down[1:] = BASE, pow(BASE, -1, 1 << 64)
        np.cumprod(self.up, out=self.up)
        np.cumprod(self.down, out=self.down)
        rows = []
        for i, (p, own) in enumerate(zip(patterns, stretches, strict=True)):
            sums = self.sums(p)
            a, b = np.array(own).T
            first, whole = (((sums[x] - sums[a]) * self.down[a]).tolist() for x in (a + q, b))
            rows += zip(first, whole, (b - a).tolist(), [i] * len(own), a.tolist(), strict=True)
        rows.sort()
        self.keys, self.whole = (np.array([r[x] for r in rows], np.uint64) for x in (0, 1))
        self.n, self.pattern, self.off = (np.array([r[x] for r in rows], np.int64) for x in (2, 3, 4))
        self.marked = np.zeros(1 << 16, bool)
        self.marked[(self.keys * MIX) >> np.uint64(48)] = True

    def sums(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + 2).astype(np.uint64) * self.up[: len(codes)], out=out[1:])
        return out

    def met(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of patterns and the places at which they would start without errors."""
        found = [(np.zeros(0, np.int64),) * 2]
        for low in range(0, len(codes), BLOCK):
            sums = self.sums(codes[low : low + BLOCK + self.longest - 1])
            n = len(sums) - 1
            if n < self.q:
                break
            first = (sums[self.q :] - sums[: -self.q]) * self.down[: n - self.q + 1]
            at = np.flatnonzero(self.marked[(first[:BLOCK] * MIX) >> np.uint64(48)])
            a, b = (np.searchsorted(self.keys, first[at], side) for side in ("left", "right"))
            seed = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum())
            at = np.repeat(at, b - a)
            fits = at + self.n[seed] <= n
            at, seed = at[fits], seed[fits]
            same = (sums[at + self.n[seed]] - sums[at]) * self.down[at] == self.whole[seed]
            found.append((self.pattern[seed[same]], at[same] + low - self.off[seed[same]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def starts_near(codes: np.ndarray, pattern: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``starts_within`` for the starts that are at most k places from one of ``near``.

    ``codes`` has k symbols before the first of them and a pattern's length and 2 k from the last on.
    """
    wide = len(pattern) + 3 * k
    cut = np.full((len(near), wide + k + 1), -1, np.int32)
    cut[:, :wide] = codes[near[:, None] - k + np.arange(wide)]
    at, err, length = starts_within(cut.ravel(), pattern, k)
    row, shift = np.divmod(at, wide + k + 1)
    own = shift <= 2 * k
    pos, first = np.unique(near[row[own]] - k + shift[own], return_index=True)
    return pos, err[own][first], length[own][first]


def edits(codes: np.ndarray, p: np.ndarray, at: np.ndarray, length: np.ndarray, err: np.ndarray, k: int) -> np.ndarray:
    """For windows of ``codes`` within k edits of a pattern a row of k numbers, the edits of ``edit_script``
    from the last to the first: place in the pattern << 23 | operation (1 X, 2 I, 3 D) << 21 | text's symbol."""
    out = np.zeros((len(at), k), np.int64)
    rows = np.flatnonzero(err)
    m, band, big = len(p), 2 * k + 1, k + 9
    t = codes[at[rows][:, None] + np.arange(m + k)]
    d = np.full((m + 1, band, len(rows)), big, np.int16)  # column j of row i is at j - i + k
    d[0, k:] = np.arange(k + 1)[:, None]
    for i in range(1, m + 1):
        for b in range(max(0, k - i), band):
            best = d[i, b]
            if b + 1 < band:
                np.minimum(best, d[i - 1, b + 1] + 1, out=best)
            if b:
                np.minimum(best, d[i, b - 1] + 1, out=best)
            if (j := i + b - k) > 0:
                np.minimum(best, d[i - 1, b] + (t[:, j - 1] != p[i - 1]), out=best)
    r = np.arange(len(rows))
    i, j, n = np.full(len(rows), m), length[rows].astype(np.int64), np.zeros(len(rows), np.int64)
    least = err[rows]
    while len(r):
        b = j - i + k
        now, sym = d[i, b, r], t[r, j - 1]
        other = sym != p[i - 1]
        diagonal = (i > 0) & (j > 0) & (d[i - 1, b, r] + other == now)
        insertion = ~diagonal & (i > 0) & (b + 1 < band) & (d[i - 1, np.minimum(b + 1, band - 1), r] + 1 == now)
        edit = ~diagonal | other
        i = i - (diagonal | insertion)
        j = j - ~insertion
        op = np.where(diagonal, 1, np.where(insertion, 2, 3))
        e = np.flatnonzero(edit)
        out[rows[r[e]], n[e]] = i[e] << 23 | op[e] << 21 | np.where(insertion[e], 0, sym[e])
        n[e] += 1
        left = n < least
        r, i, j, n, least = r[left], i[left], j[left], n[left], least[left]
    return out


@functools.lru_cache(1 << 16)
def spelled_edits(m: int, row: tuple[int, ...]) -> tuple[str, str]:
    """CIGAR and MD of a pattern of m symbols with a row of ``edits``."""
    runs: list[Run] = []
    done = 0
    for x in reversed([x for x in row if x]):
        i, op, sym = x >> 23, "=XID"[x >> 21 & 3], chr(x & 0x1FFFFF)
        if i > done:
            runs.append(("=", i - done, None))
        runs.append((op, 1, sym))
        done = i + (op != "D")
    if m > done:
        runs.append(("=", m - done, None))
    return cigar(runs), md(runs)


#: Symbols of texts that are aligned at a time, a text more or less.
AT_A_TIME = 1 << 20


def edit_pass(patterns: list[str], ids, seeds: list[list[tuple[int, int]]], classes: tuple[int, ...], k: int, filtered: bool):
    """Function of Arrow batches (doc_id, text) that makes batches (doc_id, pat_id, pos, len, err, cigar, md, w).

    Patterns of more than k characters; ``ids`` is an Arrow array.  One of a pattern's
    ``seeds``, stretches of it, has no error.  Patterns whose stretches have at least as many characters
    as one of ``classes``, largest first, are sought by so many; others by a pass over the texts.
    ``filtered``: without redundant hits, all of a pattern in a text being there.
    """
    import pyarrow as pa

    gap = 2 * k + 4  # hits of different texts are never redundant
    reach = max(map(len, patterns), default=0) + 2 * k

    least = [next((q for q in classes if min(b - a for a, b in own) >= q), 0) for own in seeds]

    def aligned(texts: list[str], sought: list[np.ndarray], met: list[tuple[list[int], Seeds]]):
        between, ends = np.full(gap, -1, np.int32), np.full(reach, -1, np.int32)
        codes = np.concatenate([ends, *(x for t in texts for x in (np.frombuffer(t.encode("utf-32-le"), np.int32), between)), ends])
        firsts = reach + np.cumsum([0, *(len(t) + gap for t in texts)])[:-1]
        parts: list[list] = [[] for _ in sought]
        for low in range(0, len(codes), BLOCK):
            block = codes[low : low + BLOCK + reach]
            for i, p in enumerate(sought):
                if not least[i]:
                    at, err, length = starts_within(block, p, k)
                    own = at < BLOCK
                    parts[i].append((at[own] + low, err[own], length[own]))
        for own, table in met:
            which, near = table.met(codes)
            order = np.argsort(which, kind="stable")
            cuts = np.searchsorted(which[order], np.arange(len(own) + 1))
            for n, i in enumerate(own):
                if cuts[n] < cuts[n + 1]:
                    parts[i].append(starts_near(codes, sought[i], np.unique(near[order[cuts[n] : cuts[n + 1]]]), k))
        made, spellings = [], []
        for i, own in enumerate(parts):
            at, err, length = (np.concatenate(x) for x in zip(*own, strict=True)) if own else (np.zeros(0, np.int64),) * 3
            if filtered and len(at) > 2:
                kept = not_redundant(at.tolist(), err.tolist(), k)
                at, err, length = at[kept], err[kept], length[kept]
            if len(at):
                seen: dict = {}
                spelling = [seen.setdefault(x, len(seen)) for x in map(tuple, edits(codes, sought[i], at, length, err, k).tolist())]
                made.append(np.stack([np.full(len(at), i), at, length, err, np.array(spelling) + len(spellings)]))
                spellings += [spelled_edits(len(sought[i]), x) for x in seen]
        i, at, length, err, spelling = np.concatenate(made, axis=1) if made else np.zeros((5, 0), np.int64)
        text = np.searchsorted(firsts, at, side="right") - 1
        return text, i, at - firsts[text] if len(at) else at, length, err, spelling, spellings

    def run(batches):
        sought = [np.frombuffer(p.encode("utf-32-le"), np.int32) for p in patterns]
        own = [(q, [i for i, x in enumerate(least) if x == q]) for q in classes]
        met = [(some, Seeds([sought[i] for i in some], [seeds[i] for i in some], q)) for q, some in own if some]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            piece = np.cumsum([0, *map(len, texts)])[:-1] // AT_A_TIME
            for low, high in itertools.pairwise([*np.flatnonzero(np.diff(piece, prepend=-1)).tolist(), len(texts)]):
                some = texts[low:high]
                text, i, pos, length, err, spelling, spellings = aligned(some, sought, met)
                spelled = [pa.DictionaryArray.from_arrays(pa.array(spelling, pa.int32()), pa.array([s[x] for s in spellings], pa.string())).dictionary_decode() for x in (0, 1)]
                w = [some[t][a:b] for t, a, b in zip(text.tolist(), pos.tolist(), (pos + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(text + low)), ids.take(pa.array(i)), pa.array(pos, pa.int64()), pa.array(length, pa.int32()), pa.array(err, pa.int32()), *spelled, pa.array(w, pa.string())],
                    ["doc_id", "pat_id", "pos", "len", "err", "cigar", "md", "w"],
                )

    return run


def edit_script(pattern: str, text: str, k: int) -> tuple[int, list[Run]]:
    """The edit distance of pattern and text (at most k, else k + 1 and no script) and a script.

    Going back from the end, a diagonal step is preferred, then an insertion, then a deletion.
    """
    m, n = len(pattern), len(text)
    d = {(0, 0): 0}
    for i in range(m + 1):
        for j in range(max(0, i - k), min(n, i + k) + 1):  # the band
            if i or j:
                ways = [d[c] + 1 for c in ((i - 1, j), (i, j - 1)) if c in d]
                if (i - 1, j - 1) in d:
                    ways.append(d[i - 1, j - 1] + (pattern[i - 1] != text[j - 1]))
                d[i, j] = min(ways)
    if (total := d.get((m, n), k + 1)) > k:
        return k + 1, []
    steps: list[Run] = []
    i, j = m, n
    while i or j:
        now = d[i, j]
        if i and j and d.get((i - 1, j - 1), k + 9) + (pattern[i - 1] != text[j - 1]) == now:
            i, j = i - 1, j - 1
            steps.append(("=", 1, None) if pattern[i] == text[j] else ("X", 1, text[j]))
        elif i and d.get((i - 1, j), k + 9) + 1 == now:
            i -= 1
            steps.append(("I", 1, pattern[i]))
        else:
            j -= 1
            steps.append(("D", 1, text[j]))
    return total, joined(steps[::-1])


def prefix_script(pattern: str, text: str, k: int) -> tuple[int, int, list[Run]]:
    """Distance, length and script of the best prefix of the text; no script beyond k."""
    if not pattern:
        return 0, 0, []
    (err,), (length,) = best_prefixes([pattern], [text], k, least=0)
    return int(err), int(length), edit_script(pattern, text[:length], k)[1] if err <= k else []


def hamming_script(pattern: str, text: str) -> list[Run]:
    return joined([("=", 1, None) if p == t else ("X", 1, t) for p, t in zip(pattern, text, strict=True)])


def joined(steps: list[Run]) -> list[Run]:
    """Matches that follow one another as one run."""
    out: list[Run] = []
    for op, n, sym in steps:
        if op == "=" and out and out[-1][0] == "=":
            out[-1] = ("=", out[-1][1] + n, None)
        else:
            out.append((op, n, sym))
    return out


def script_edits(pattern: str, text: str, runs: list[Run]) -> int:
    """The number of edits; -1 if the runs do not turn the pattern into the text."""
    i = j = edits = 0
    for op, n, sym in runs:
        for _ in range(n):
            p, t = pattern[i : i + 1], text[j : j + 1]
            valid = {"=": p and p == t, "X": p and t and p != t and t == sym, "I": p and p == sym, "D": t and t == sym}[op]
            if not valid:
                return -1
            i, j, edits = i + (op != "D"), j + (op != "I"), edits + (op != "=")
    return edits if (i, j) == (len(pattern), len(text)) else -1


def cigar(runs) -> str:
    """As in ``5=1X2I3=``: runs of one operation are one."""
    return "".join(f"{sum(r[1] for r in same)}{op}" for op, same in ((o, list(g)) for o, g in itertools.groupby(runs, key=lambda r: r[0])))


def md(runs) -> str:
    """As in ``10G5^TA6``: matching stretches, the text's symbols where they differ, deletions after ``^``."""
    out, n, deleting = [], 0, False
    for op, length, sym in runs:
        if op == "=":
            n += length
        elif op == "X":
            out.append(f"{n}{sym}")
            n = 0
        elif op == "D":
            if not deleting:
                out.append(f"{n}^")
                n = 0
            out.append(sym or "")
        deleting = op == "D"
    return "".join([*out, str(n)])


ALIGNED = f"err int, len int, cigar string, md string, runs {RUNS}"


def edit_alignment(k: int):
    """Column function (pattern, text): struct of ALIGNED for the text's best prefix, least 1 long."""

    @F.pandas_udf(f"struct<{', '.join(c.replace(' ', ': ', 1) for c in ('err int', 'len int', 'cigar string', 'md string', 'runs ' + RUNS))}>")
    def run(pattern: pd.Series, text: pd.Series) -> pd.DataFrame:
        err, length = best_prefixes(list(pattern), list(text), k)
        scripts = [edit_script(p, t[:n], k)[1] if e <= k else [] for p, t, e, n in zip(pattern, text, err, length, strict=True)]
        return _frame(err, length, scripts)

    return run


@functools.lru_cache(1 << 15)
def _spelled(pattern: str, window: str, k: int) -> tuple[str, str]:
    """Short patterns meet the same windows over and over; a process keeps their spellings."""
    script = edit_script(pattern, window, k)[1]
    return cigar(script), md(script)


@functools.lru_cache(1 << 15)
def _runs(pattern: str, window: str, cigar: str) -> list[dict]:
    out, i, j = [], 0, 0
    for n, op in re.findall(r"(\d+)([=XID])", cigar):
        for _ in range(1 if op == "=" else int(n)):
            length = int(n) if op == "=" else 1
            out.append({"op": op, "len": length, "sym": {"=": None, "I": pattern[i : i + 1]}.get(op, window[j : j + 1])})
            i, j = i + length * (op != "D"), j + length * (op != "I")
    return out


def window_spelling(k: int):
    """Column function (pattern, window of the text within k edits of it): struct (cigar, md)."""

    @F.pandas_udf("struct<cigar: string, md: string>")
    def run(pattern: pd.Series, window: pd.Series) -> pd.DataFrame:
        made = [_spelled(p, w, k) for p, w in zip(pattern, window, strict=True)]
        return pd.DataFrame({"cigar": [x[0] for x in made], "md": [x[1] for x in made]})

    return run


def window_runs():
    """Column function (pattern, window, CIGAR): its runs as in an edit script."""

    @F.pandas_udf(RUNS)
    def run(pattern: pd.Series, window: pd.Series, cigars: pd.Series) -> pd.Series:
        return pd.Series([_runs(*x) for x in zip(pattern, window, cigars, strict=True)], dtype=object)

    return run


def hamming_alignment():
    """Column function (pattern, text of the same length): struct of ALIGNED."""

    @F.pandas_udf(f"struct<{', '.join(c.replace(' ', ': ', 1) for c in ('err int', 'len int', 'cigar string', 'md string', 'runs ' + RUNS))}>")
    def run(pattern: pd.Series, text: pd.Series) -> pd.DataFrame:
        scripts = [hamming_script(p, t) for p, t in zip(pattern, text, strict=True)]
        return _frame([sum(r[0] == "X" for r in s) for s in scripts], [len(p) for p in pattern], scripts)

    return run


def edit_window(k: int):
    """Column function (pattern, text): struct (err, len) of the text's best prefix; no script is made."""

    @F.pandas_udf("struct<err: int, len: int>")
    def run(pattern: pd.Series, text: pd.Series) -> pd.DataFrame:
        err, length = best_prefixes(list(pattern), list(text), k)
        return pd.DataFrame({"err": err, "len": length})

    return run


def _frame(err, length, scripts) -> pd.DataFrame:
    runs = [[{"op": o, "len": n, "sym": s} for o, n, s in script] for script in scripts]
    return pd.DataFrame({"err": err, "len": length, "cigar": [cigar(s) for s in scripts], "md": [md(s) for s in scripts], "runs": runs})
