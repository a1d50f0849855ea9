"""Near-duplicate vectors within labels by range search on a robust-pruned flat graph.

1. Equal vectors of a label collapse to one vertex with a weight and a number of its own.
2. Vertices are dealt to overlapping *regions* of at most REGION to be searched.  A label's
   vertices are one cell; a larger cell is split around pivots drawn from it by hash, as many
   as its size asks for, and so on: pivots grow with the data, and those of a cell travel to
   its rows in a table.  A vertex goes to the cell of its nearest pivot p, its home, and as a
   guest to every cell that may hold a partner of its: a partner u at home with q has
   u(p - q) <= 0 and is at most a step away, so x(p - q) <= step |p - q|.  No link is lost.
   Where that repeats too many rows, since vectors are nearly orthogonal or all alike, a cell
   is split without that proof: a vertex goes to the OVERLAP nearest pivots.
3. Vertices at home within half the linking angle of their pivot are a *ball*: by the triangle
   inequality all of them are linked, so a hot ball of near copies needs a sum.  They are
   searched only if the cell has others near enough to link.
4. Within a region, overlapping shards of some 2 CLUSTER vertices build robust-pruned lists of
   neighbours; a vertex's lists from all its shards, in all regions, are united: one flat graph.
5. Every vertex searches the flat graph in its home and where it is a guest, from the medoids
   of its shards and its own place: greedily with a beam and, in range, by expanding all that is
   found.  A link is counted where its target is at home, so once.  In cells split without
   proof the search goes on from neighbours that lie elsewhere, in the regions where these are
   at home, and what it finds there is sent to the query's home, in rounds, until no new region
   is reached.  Links are verified in double precision;
   a task returns sums and a spanning forest.
6. A fixed number of vertices is compared with all vectors in blocks: linked ones, spread by
   hash over regions and numbers of links so that hot balls do not crowd the others out, and as
   many for which no link was found.  The audit is logged and returned; if any has other links
   than were found, the search is done again with a wider beam, ATTEMPTS times at most.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and those with a null label or id, link with nothing and are kept; vectors of unequal
length are not compared; a row's links are the other rows whose vectors link with its own,
rows of the same id included; rows that share an id are one vertex of the components; only
vec_id, embedding and label are read, so other columns may have any name.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import slices, stored
from lexiloom.llm.components import connected_components
from lexiloom.llm.groups import Forest, grouped

#: Vertices that are searched in one task; rows placed at a time in one task.
REGION, PLACING = 8192, 1 << 16
#: Pivots drawn for a split, at least and at most; rows a proven split may make of one; splits in a row.
PIVOTS, GROWTH, LEVELS = (16, 256), 3, 10
#: A region's shards: vertices for each centre, and shards that each vertex is in.
CLUSTER, OVERLAP = 64, 2
DEGREE, BACK, POOL, ALPHA = 16, 16, 48, 1.2
BEAM, EXPAND, ATTEMPTS = 16, 4, 3
#: Audited vertices with links, and without; slots of a region's vertices with about as many links.
AUDITED, SLOTS = 256, 16
#: Similarities of single precision that are verified in double.
MARGIN = 1e-4

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Audit:
    """Vertices compared with brute force, those with other links, the share of true links found."""

    audited: int
    missed: int
    recall: float


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = []
        for x, label, i in zip(batch.column("x"), batch.column("label"), batch.column("vec_id"), strict=True):
            ok = x.is_valid and label.is_valid and i.is_valid and len(x.values) and not x.values.null_count
            if ok:
                a = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                ok = np.isfinite(a).all() and a.any()
            hashes.append(xxhash.xxh3_128_digest((a + 0.0).tobytes()) if ok else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.binary())], ["vec_id", "label", "x", "h"])


def _unit(rows) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


# ---- regions

ROWS = "cell long, v long, lead long, w long, x array<double>, own boolean, ball long, ring boolean, sure boolean"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.bool_(), pa.int64(), pa.bool_(), pa.bool_())


def _child(cell: int, pivots: np.ndarray) -> np.ndarray:
    """A number for the part of a cell around each pivot."""
    x = np.uint64(cell & 0xFFFFFFFFFFFFFFFF) ^ ((pivots.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)).view(np.int64)


def _thinned(pivots: np.ndarray, apart: float) -> np.ndarray:
    kept: list[np.ndarray] = []
    for x in pivots:
        if not kept or (np.array(kept) @ x).max() < apart:
            kept.append(x)
    return np.array(kept)


def _placed(threshold: float):
    """The rows of each (cell, slice), whose pivots come first, as rows of its parts."""
    angle = math.acos(threshold)
    core, ring = math.cos(angle / 2) + 1e-9, math.cos(min(1.5 * angle, math.pi)) - 1e-9
    step, apart = math.sqrt(2 - 2 * threshold), math.cos(min(3 * angle, math.pi))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivots = None, np.empty((0, 0))
        for batch in slices(batches, 2048):
            cells, slice_ = batch.column("cell").to_numpy(), batch.column("slice").to_numpy()
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (slice_[1:] != slice_[:-1])) + 1
            source, child, own, ball, ringed = [], [], [], [], []
            owned, rings = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "ring"))
            balls = np.array([*batch.column("ball").to_pylist(), None], object)[:-1]
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)], strict=True):
                proven = batch.column("sure")[a].as_py()
                if (cells[a], slice_[a]) != key:
                    key, pivots = (cells[a], slice_[a]), np.empty((0, 0))
                if (drawn := batch.column("pivots")[a]).is_valid:
                    pivots = _unit(drawn.as_py())
                    pivots, a = _thinned(pivots, apart) if proven else pivots, a + 1
                if a == b:
                    continue
                at = np.arange(a, b)
                if not len(pivots):
                    pivots = np.zeros((1, len(batch.column("x")[a])))
                sims = _unit(batch.column("x").slice(a, b - a).to_pylist()) @ pivots.T
                best = sims.argmax(axis=1)
                top = sims[np.arange(len(at)), best]
                names = _child(int(cells[a]), np.arange(len(pivots)))
                source.append(at)
                child.append(names[best])
                own.append(owned[at].astype(bool))
                if proven:
                    inside = own[-1] & (top >= core)
                    ball.append(np.where(inside, names[best].astype(object), None))
                    ringed.append((top >= ring) & ~inside)
                    # how far two linked vectors may disagree about two pivots
                    gap = step * np.sqrt(np.maximum(2 - 2 * (pivots[best] @ pivots.T), 0)) + 1e-9
                    guest = top[:, None] - sims <= gap
                    guest[np.arange(len(at)), best] = False
                    r, p = np.nonzero(guest)
                    source.append(at[r])
                    child.append(names[p])
                    own.append(np.zeros(len(r), bool))
                    ball.append(np.full(len(r), None))
                    ringed.append(sims[r, p] >= ring)
                else:
                    ball.append(balls[at])
                    ringed.append(rings[at].astype(bool))
                    for _ in range(min(OVERLAP, len(pivots)) - 1):
                        sims[np.arange(len(at)), best] = -2
                        best = sims.argmax(axis=1)
                        source.append(at)
                        child.append(names[best])
                        own.append(np.zeros(len(at), bool))
                        ball.append(ball[-1])
                        ringed.append(ringed[-1])
            if not source:
                continue
            rows = pa.array(np.concatenate(source))
            held = [None if b is None else int(b) for b in np.concatenate(ball)]
            kept = [batch.column(c).take(rows) for c in ("cell", "v", "lead", "w", "x")]
            made = [pa.array(np.concatenate(own)), pa.array(held, pa.int64()), pa.array(np.concatenate(ringed)), batch.column("sure").take(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(child)), *kept[1:], *made, kept[0]], [c.split()[0] for c in (ROWS + ", parent long").split(", ")])

    return run


def regions(vertices: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of vertices (v, lead, w, label, x): the ROWS to be searched, by region; and the balls' rows."""
    rows = vertices.select(
        F.xxhash64("label", F.size("x")).alias("cell"), "v", "lead", "w", "x", F.lit(True).alias("own"),
        F.lit(None).cast("long").alias("ball"), F.lit(False).alias("ring"), F.lit(True).alias("sure"),
    )
    names = rows.columns
    leaves, balls = [], []
    for level in range(LEVELS + 1):
        n_ball = F.when(F.bool_and("sure") & (F.count_if("ring") == 0), F.count_if(F.col("ball").isNotNull())).otherwise(0)
        sizes = stored(rows.groupBy("cell").agg(F.count("*").alias("n"), n_ball.alias("n_settled")), "sizes")
        sizes = sizes.withColumn("open", F.col("n") - F.col("n_settled"))
        # what LEVELS splits did not part is searched as it is: none is known, since pivots are where vectors are
        big = sizes.where((F.col("open") > REGION) & F.lit(level < LEVELS))
        done = rows.join(sizes.where((F.col("open") <= REGION) | F.lit(level == LEVELS)), "cell")
        balls.append(done.where("own AND ball IS NOT NULL AND sure").select("ball", "v", "lead", "w"))
        leaves.append(done.where("ball IS NULL OR n_settled = 0").select(names))
        if big.isEmpty():
            break
        rows = rows.join(big.select("cell", "n", "n_settled"), "cell")
        drawn = F.pmod(F.xxhash64("v", F.lit(level)), F.lit(1 << 30))
        wanted = F.least(F.greatest(4 * F.col("n") / REGION, F.lit(PIVOTS[0])), F.lit(PIVOTS[1]))
        pivots = rows.where(F.col("own") & (drawn < wanted / F.col("n") * (1 << 30))).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct(drawn.alias("d"), "x"))).alias("p"), F.first("sure").alias("sure"), F.first("n").alias("n"))
        n_slices = F.ceil(F.col("n") / PLACING)
        pivots = pivots.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), n_slices - 1)).alias("slice"), F.transform("p", lambda d: d["x"]).alias("pivots"), "sure")
        both = rows.withColumn("slice", F.pmod(F.xxhash64("v"), n_slices)).withColumn("pivots", F.lit(None).cast("array<array<double>>")).unionByName(pivots, allowMissingColumns=True)
        both = both.repartition("cell", "slice").sortWithinPartitions("cell", "slice", F.col("pivots").isNull())
        placed = stored(both.select("slice", "pivots", *names).mapInArrow(_placed(threshold), ROWS + ", parent long"), "placed")
        grown = placed.where("sure").groupBy("parent").agg(F.count("*").alias("made"), F.countDistinct("cell").alias("parts"))
        failed = stored(grown.join(big.select(F.col("cell").alias("parent"), "n"), "parent").where((F.col("made") > GROWTH * F.col("n")) | (F.col("parts") == 1)).select(F.col("parent").alias("cell")), "failed")
        back = rows.join(failed, "cell")
        balls.append(back.where("own AND ball IS NOT NULL").select("ball", "v", "lead", "w"))
        back = back.where("ball IS NULL OR n_settled = 0").select(*names[:-1], F.lit(False).alias("sure"))
        rows = stored(placed.join(failed.toDF("parent"), "parent", "left_anti").select(names).union(back.select(names)), "cells")
    out = [leaves[0], balls[0]]
    for k, each in ((0, leaves), (1, balls)):
        for more in each[1:]:
            out[k] = out[k].union(more)
    return stored(out[0], "regions"), stored(out[1], "balls")


# ---- graphs


def pruned(x: np.ndarray) -> np.ndarray:
    """Neighbours of each unit vector of a shard, -1 where there are fewer: DEGREE of its own,
    robust-pruned, and the ways back to those that chose it.

    The nearest of the candidates is taken; those that lie closer to it, by the factor
    ALPHA, than to the vector itself are let go; and so on.
    """
    n = len(x)
    if n == 1:
        return np.full((1, 1), -1, np.int64)
    d = (1 - x @ x.T).astype(np.float32)
    np.fill_diagonal(d, np.inf)
    k = min(POOL, n - 1)
    pool = np.argpartition(d, k - 1, axis=1)[:, :k]
    own = np.take_along_axis(d, pool, 1)
    order = np.argsort(own, axis=1, kind="stable")
    pool, own = np.take_along_axis(pool, order, 1), np.take_along_axis(own, order, 1)
    alive, rows = np.ones(pool.shape, np.bool_), np.arange(n)
    out = np.full((n, DEGREE), -1, np.int64)
    for step in range(DEGREE):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        taken = pool[rows, first]
        out[some, step] = taken[some]
        alive[rows, first] = False
        alive &= ALPHA * d[taken[:, None], pool] > own
    return np.hstack([out, _back(out, d)])


def _back(out: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Ways back to those that chose a vector, -1 for fewer, so that all can be reached.

    A vector leads to the BACK nearest of its choosers, and each chooser to the one BACK
    places farther: no vector gets more than DEGREE of these for the DEGREE it chose.
    """
    source, target = np.repeat(np.arange(len(out)), out.shape[1]), out.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.lexsort((d[source, target], target))
    source, target = source[order], target[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    far = np.flatnonzero(rank >= BACK)
    holder = np.concatenate((target[rank < BACK], source[far - BACK]))
    held = np.concatenate((source[rank < BACK], source[far]))
    order = np.argsort(holder, kind="stable")
    holder, held = holder[order], held[order]
    back = np.full((len(out), BACK + DEGREE), -1, np.int64)
    back[holder, np.arange(len(holder)) - np.searchsorted(holder, holder)] = held
    return back


def shards_of(x: np.ndarray) -> np.ndarray:
    """For each vector of a region the numbers of its OVERLAP shards, those of its nearest centres."""
    n = max(1, len(x) // CLUSTER)
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)]
    k = min(OVERLAP, n)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 2048):
        sims = x[at : at + 2048] @ centres.T
        out[at : at + 2048] = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < n else np.arange(n)
    return out


def members(shards: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each shard's vectors."""
    order = np.argsort(shards.ravel(), kind="stable")
    cuts = np.flatnonzero(np.diff(shards.ravel()[order])) + 1
    for part in np.split(order, cuts):
        yield part // shards.shape[1]


def united_graph(x: np.ndarray, shards: np.ndarray) -> list[np.ndarray]:
    """Each vector's neighbours, from the graphs of all its shards."""
    lists: list[list[np.ndarray]] = [[] for _ in x]
    for at in members(shards):
        near = pruned(x[at])
        for i, k in zip(at.tolist(), near, strict=True):
            lists[i].append(at[k[k >= 0]])
    return [np.unique(np.concatenate(each)) for each in lists]


def medoids_of(x: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """Each shard's vector that is nearest to all of it; -1 for numbers without a shard."""
    out = np.full(int(shards.max()) + 1, -1, np.int64)
    for at in members(shards):
        # of unit vectors, the one nearest to their mean has the largest sum of similarities
        name = np.bincount(shards[at].ravel()).argmax()
        out[name] = at[int((x[at] @ x[at].mean(axis=0)).argmax())]
    return out


def range_search(queries: np.ndarray, starts: np.ndarray, x: np.ndarray, near: np.ndarray, least: float, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, place in ``x``) found with a similarity of ``least``.

    ``near`` has each vector's neighbours and ``starts`` each query's first places, -1 for
    none.  The best WIDTH places of a query are its beam; what is in range is expanded besides.
    """
    n, rows = len(x), len(queries)
    seen = np.zeros(rows * n, np.bool_)
    beam, score = np.full((rows, width), -1, np.int64), np.full((rows, width), -2, np.float32)
    done = np.ones((rows, width), np.bool_)
    found: list[np.ndarray] = []

    def visit(q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Compares, keeps what is in range, renews the beams; pairs in range that left or missed them."""
        nonlocal beam, score, done
        keys = (q * n + at)[at >= 0]
        keys = np.unique(keys[~seen[keys]])
        seen[keys] = True
        q, at = keys // n, keys % n
        sim = np.einsum("kd,kd->k", queries[q], x[at])
        inside = sim >= least
        found.append(keys[inside])
        q, at, sim, rest = q[~inside], at[~inside], sim[~inside], keys[inside]
        order = np.lexsort((-sim, q))
        q, at, sim = q[order], at[order], sim[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        few = place < width
        more, value = np.full((rows, width), -1, np.int64), np.full((rows, width), -2, np.float32)
        more[q[few], place[few]], value[q[few], place[few]] = at[few], sim[few]
        ids, values, closed = np.hstack([beam, more]), np.hstack([score, value]), np.hstack([done, more < 0])
        best = np.argpartition(-values, width - 1, axis=1)[:, :width]
        beam, score, done = (np.take_along_axis(m, best, 1) for m in (ids, values, closed))
        return rest

    pending = visit(np.repeat(np.arange(rows), starts.shape[1]), starts.ravel())
    while True:
        value = np.where(done, -3, score)
        k = min(EXPAND, width)
        pick = np.argpartition(-value, k - 1, axis=1)[:, :k]
        ok = np.take_along_axis(value, pick, 1) > -3
        q, p = np.nonzero(ok)
        p = pick[q, p]
        at = beam[q, p]
        done[q, p] = True
        q, at = np.concatenate((q, pending // n)), np.concatenate((at, pending % n))
        if not len(q):
            break
        parts = []
        for k in range(0, len(q), 1 << 14):
            parts.append(visit(np.repeat(q[k : k + (1 << 14)], near.shape[1]), near[at[k : k + (1 << 14)]].ravel()))
        pending = np.concatenate(parts)
    keys = np.concatenate(found)
    return keys // n, keys % n


# ---- search


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The neighbours of every vertex of a region."""
    for rows in grouped(batches, ["cell"]):
        v, x = rows.column("v").to_numpy(), _unit(rows.column("x").to_pylist()).astype(np.float32)
        lists = [v[k] for k in united_graph(x, shards_of(x))]
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(lists, pa.list_(pa.int64()))], ["v", "near"])


FOUND = "v long, links long, a long, b long, q long, entry long"


def _searched(threshold: float, width: int):
    """Of each region: its queries' weights of links; a spanning forest; for regions without proof,
    the queries in range of a vertex with neighbours elsewhere, and those neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["cell"]):
            member, asks, own, sure = (rows.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("member", "asks", "own", "sure"))
            v, lead, w = (rows.column(c).to_numpy() for c in ("v", "lead", "w"))
            ball = np.array([0 if b is None else b for b in rows.column("ball").to_pylist()], np.int64)
            t, q = np.flatnonzero(member), np.flatnonzero(asks)
            if not len(t) or not len(q):
                continue
            raw = np.array(rows.column("x").to_pylist(), np.float64)
            norm = np.linalg.norm(raw, axis=1)
            x = (raw / norm[:, None]).astype(np.float32)
            place = {int(i): k for k, i in enumerate(v[t])}
            lists = [rows.column("near")[int(r)].as_py() or () for r in t]
            near = np.full((len(t), max(map(len, lists)) or 1), -1, np.int64)
            away: list[list[int]] = [[] for _ in t]
            for k, each in enumerate(lists):
                inside = [p for i in each if (p := place.get(i)) is not None]
                near[k, : len(inside)] = inside
                if not sure[t[k]]:
                    away[k] = [i for i in each if i not in place]
            shards = shards_of(x[t])
            medoids = medoids_of(x[t], shards)
            forest, sums, credit = Forest(len(v)), np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
            home = rows.column("home").to_pylist()
            goes_on: set[tuple[int, int]] = set()
            calls: dict[tuple, tuple[int, int]] = {}
            entries = rows.column("entries")
            for at in range(0, len(q), 512):
                part = q[at : at + 512]
                first = np.full((len(part), shards.shape[1] + 1), -1, np.int64)
                told = [entries[int(r)].as_py() or () for r in part]
                wide = max(map(len, told))
                extra = np.full((len(part), wide), -1, np.int64)
                for k, r in enumerate(part.tolist()):
                    mine = place.get(int(v[r]))
                    if mine is not None:
                        first[k, :-1], first[k, -1] = medoids[shards[mine]], mine
                    known = [place[i] for i in told[k] if i in place]
                    extra[k, : len(known)] = known
                i, j = range_search(x[part], np.hstack([first, extra]), x[t], near, threshold - MARGIN, width)
                a, b = part[i], t[j]
                some = v[a] != v[b]
                a, b, j = a[some], b[some], j[some]
                cosine = np.einsum("kd,kd->k", raw[a], raw[b]) / (norm[a] * norm[b])
                some = cosine >= threshold
                a, b, j = a[some], b[some], j[some]
                for k in np.flatnonzero([bool(away[p]) for p in j]).tolist():
                    goes_on.update((int(v[a[k]]), e) for e in away[j[k]])
                # what a query from elsewhere finds at home is to visit that query's home in turn
                for k, m in zip(*(i[own[b] & ~own[a] & ~sure[b]].tolist() for i in (a, b)), strict=True):
                    calls.setdefault((m, home[k]), (int(v[m]), int(v[k])))
                # a link is counted where its target is at home, but those within a ball by its sum
                some = own[b] & ((ball[a] != ball[b]) | (ball[b] == 0))
                a, b = a[some], b[some]
                np.add.at(sums, a, w[b])
                back = own[a] & sure[b] & (ball[b] != 0)
                np.add.at(credit, b[back], w[a[back]])
                for k, m in zip(a.tolist(), b.tolist(), strict=True):
                    forest.join(k, m)
            total = sums + credit
            out = [(int(v[r]), int(total[r]), None, None, None, None) for r in np.flatnonzero(total)]
            out += [(None, None, int(lead[i]), int(lead[j]), None, None) for i, j in forest.links]
            out += [(None, None, None, None, i, e) for i, e in sorted(goes_on | set(calls.values()))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return run


def search(rows: DataFrame, balls: DataFrame, threshold: float, width: int = BEAM) -> tuple[DataFrame, DataFrame]:
    """Of regions' rows and balls: (v, links), the weight linked; links (a, b) that span, between leads."""
    by_region = rows.select("cell", "v", "x").repartition("cell").sortWithinPartitions("cell", "v")
    lists = by_region.mapInArrow(_adjacent, "v long, near array<long>")
    flat = stored(lists.groupBy("v").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    inside = stored(rows.join(flat, "v").withColumns({"member": F.lit(True), "entries": F.lit(None).cast("array<long>")}), "searched")
    proven = rows.where("NOT sure").isEmpty()
    homes = stored(rows.where("own").select("v", F.col("cell").alias("home")), "homes") if not proven else None
    inside = inside.withColumn("home", F.lit(None).cast("long")) if proven else stored(inside.join(homes, "v", "left"), "searched")
    asks = F.col("ball").isNull() | ~F.col("sure")
    columns = ["cell", "v", "lead", "w", "x", "own", "ball", "sure", "near", "member", "entries", "home", "asks"]

    def found_in(dealt: DataFrame) -> DataFrame:
        dealt = dealt.repartition("cell").sortWithinPartitions("cell", "v", F.desc("member"))
        return stored(dealt.mapInArrow(_searched(threshold, width), FOUND), "found")

    found = [found_in(inside.withColumn("asks", asks).select(columns))]
    if not proven:
        # balls at home count as there: what asks for them there is credited to them
        visited = stored(inside.select(F.col("v").alias("q"), "cell"), "visited")
        while True:
            more = found[-1].where("q IS NOT NULL").select("q", "entry").distinct().join(homes.toDF("entry", "cell"), "entry").join(visited, ["q", "cell"], "left_anti")
            more = stored(more.groupBy("q", "cell").agg(F.collect_set("entry").alias("entries")), "messages")
            if more.isEmpty():
                break
            asking = inside.where("own").select(F.col("v").alias("q"), "v", "lead", "w", "x", "ball", "sure", "home").join(more, "q")
            asking = asking.withColumns({"own": F.lit(False), "near": F.lit(None).cast("array<long>"), "member": F.lit(False), "asks": F.lit(True)}).select(columns)
            held = inside.join(more.select("cell").distinct(), "cell", "left_semi").withColumn("asks", F.lit(False)).select(columns)
            found.append(found_in(held.union(asking)))
            visited = stored(visited.union(more.select("q", "cell")), "visited")
    everything = found[0]
    for more in found[1:]:
        everything = everything.union(more)

    sums = stored(balls.groupBy("ball").agg(F.sum("w").alias("n"), F.min("lead").alias("first")), "ball sums")
    core = balls.join(sums, "ball")
    counts = everything.where("v IS NOT NULL").select("v", "links").union(core.select("v", F.col("n") - F.col("w")))
    links = everything.where("a IS NOT NULL").select("a", "b").union(core.select(F.col("first").alias("a"), F.col("lead").alias("b")))
    return stored(counts.groupBy("v").agg(F.sum("links").alias("links")), "counts"), links


def audit(vertices: DataFrame, rows: DataFrame, counts: DataFrame, threshold: float) -> Audit:
    """Vertices of the regions, drawn as the module says, against brute force."""
    drawn = F.xxhash64("v", F.lit("audit"))
    known = rows.where("own").select("v", "cell").join(counts, "v", "left").select("v", "cell", F.coalesce("links", F.lit(0)).alias("links"), drawn.alias("at"))
    alike = known.where("links > 0").groupBy("cell", F.floor(F.log2("links")).alias("size"), F.pmod("at", F.lit(SLOTS)).alias("slot"))
    linked = alike.agg(F.min_by("v", "at").alias("v")).orderBy(drawn, "v").limit(AUDITED)
    lone = known.where("links = 0").orderBy("at", "v").limit(AUDITED)
    ids = linked.select("v").union(lone.select("v")).distinct()
    asked = vertices.join(ids, "v").join(counts, "v", "left").select("v", "label", "x", F.coalesce("links", F.lit(0)).alias("links")).collect()
    shared = vertices.sparkSession.sparkContext.broadcast([(r.v, r.label, r.x) for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        asked_of: dict[tuple, list] = {}
        for i, label, x in shared.value:
            asked_of.setdefault((label, len(x)), []).append((i, x))
        for batch in slices(batches, 4096):
            ids, w = batch.column("v").to_numpy(), batch.column("w").to_numpy()
            vectors_, at_of = batch.column("x").to_pylist(), {}
            for r, label in enumerate(batch.column("label").to_pylist()):
                at_of.setdefault((label, len(vectors_[r])), []).append(r)
            for key in asked_of.keys() & at_of.keys():
                at = at_of[key]
                hit = _unit([x for _, x in asked_of[key]]) @ _unit([vectors_[r] for r in at]).T >= threshold
                for k, (i, _) in enumerate(asked_of[key]):
                    sums[i] = sums.get(i, 0) + int(w[at][hit[k] & (ids[at] != i)].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["v", "links"])

    true = {r.v: r.links for r in vertices.mapInArrow(run, "v long, links long").groupBy("v").agg(F.sum("links").alias("links")).collect()}
    total = sum(true.values())
    got = sum(min(true.get(r.v, 0), r.links) for r in asked)
    return Audit(len(asked), sum(true.get(r.v, 0) != r.links for r in asked), got / total if total else 1.0)


def near_vectors(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) for every row of ``rows`` (vec_id, embedding, label);
    ``recall`` is that of the last audit."""
    made = rows.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("x"))
    kind = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, x array<double>, h binary"
    made = stored(made.mapInArrow(_prepared, kind), "vectors")
    full = made.where("h IS NOT NULL")
    groups = full.groupBy("label", "h").agg(F.min("vec_id").alias("lead"), F.count("*").alias("w"), F.first("x").alias("x"))
    # numbered once, as the table is written; ids may repeat across labels
    vertices = stored(groups.withColumn("v", F.monotonically_increasing_id()), "vertices")
    placed, balls = regions(vertices, threshold)
    for attempt in range(ATTEMPTS):
        counts, links = search(placed, balls, threshold, BEAM << (2 * attempt))
        told = audit(vertices, placed, counts, threshold)
        log.warning("search %d at %s: %d of %d audited vertices differ, recall %.6f", attempt + 1, threshold, told.missed, told.audited, told.recall)
        if not told.missed:
            break
    of = full.select("vec_id", "label", "h").join(vertices.select("label", "h", "v", "lead", "w"), ["label", "h"])
    equal = of.where("vec_id <> lead").select(F.col("vec_id").alias("a"), F.col("lead").alias("b"))
    component = connected_components(links.union(equal)).toDF("vec_id", "component_id")
    linked = of.join(counts, "v", "left").select("vec_id", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    lone = made.where("h IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    out = linked.union(lone).join(component, "vec_id", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return out.select("vec_id", "n_links", "component_id", kept, F.lit(told.recall).alias("recall"))
