"""Removing repeated byte strings by merging shard Burrows-Wheeler transforms.

Every string of ``LENGTH`` bytes has an *anchor*, its smallest 32-byte piece by hash, the
leftmost of equals.  Neighbouring strings share anchors; the strings of one anchor are a
*stretch* of text.  Equal strings have equal anchors, so repeats are found among
stretches of equal anchor key, and only suffixes near anchors ever need sorting: some
hundredth of all.

1. A pass over the texts gives (key, hash of the stretch, place) for every stretch.  Keys
   found once are dropped; stretches found twice are repeated as a whole.
2. Keys with several different stretches are left.  Their stretches are dealt by key to
   tasks.  A task takes them in shards of bounded size and sorts each shard's suffixes at
   the anchor: the shard's (sparse) transform.  The shards' orders are merged by refining
   their interleave, eight symbols an iteration, with blocks that one shard alone fills
   left as they are.
3. From the merged order, every step of the LF-mapping moves all suffixes one symbol to
   the left: a stable partition by the symbol before, which refines the blocks, while the
   common prefixes of neighbours follow by range minima.  No suffix is sorted again.
   Neighbours with ``LENGTH`` symbols in common are a repeated interval: their strings
   repeat.  Blocks of one suffix are dropped as they arise.
4. A key of more than ``MOST`` different stretches is split before: each stretch is halved
   into the stretches of its left and right strings, keyed by what all of their strings
   have in common.  That parts what differs and unites what is equal; after eight halvings
   a stretch is one string, and equal ones are one row.  So no task gathers a hot key.

Documents with a repeat are the only ones whose text is moved, to meet its spans.

Defined results: null is the empty text; rows that agree in doc_id and text are documents
of their own and repeat each other; stretches are compared by 128 bits of hash (key and
content) where whole, byte by byte otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.bloom import id_filter
from lexiloom.llm.common import stored

LENGTH = 200
PIECE = 32
#: Windows hashed at a time; places within fit 20 bits.
PART = 1 << 19
MOST = 2048
#: Stretches of a shard, and of what a task merges at once.
SHARD, GATHER = 2048, 8192

_MASK = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def piece_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash for each run of PIECE bytes, by doubling."""
    h, m = _BYTES[buf], 1
    while m < PIECE:
        h = h[:-m] * np.uint64(pow(_BASE, m, 1 << 64)) + h[m:]
        m *= 2
    return _mixed(h)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = len(v)
    padded = np.full(-(-n // width) * width, np.iinfo(v.dtype).max, v.dtype)
    padded[:n] = v
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string of LENGTH bytes its anchor's place; and the hash of every piece."""
    h = piece_hashes(buf)
    v = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)
    return (sliding_min(v, LENGTH - PIECE + 1) & _MASK).astype(np.int64), h


def stretches(texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, first string's place, strings, anchor's distance from it, key) of every stretch."""
    parts: list[tuple[int, int, bytes]] = []
    held = 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), PART):
            part = t[at : at + PART + LENGTH - 1]
            if held + len(part) > PART + LENGTH:
                yield from _stretches(parts)
                parts, held = [], 0
            parts.append((i, at, part))
            held += len(part)
    yield from _stretches(parts)


def _stretches(parts: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int, int, int]]:
    if not parts:
        return
    place, h = anchors(np.frombuffer(b"".join(p for _, _, p in parts), np.uint8))
    base = 0
    for i, at, part in parts:
        n = len(part) - LENGTH + 1
        a = place[base : base + n]
        starts = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1))
        count = np.diff(np.append(starts, n))
        own = a[starts]
        keys = h[own].view(np.int64).tolist()
        yield from zip([i] * len(starts), (starts + at).tolist(), count.tolist(), (own - base - starts).tolist(), keys, strict=True)
        base += len(part)


def text_hash(doc_id: int | None, text: bytes) -> int:
    """Tells rows of one doc_id with different texts apart."""
    return xxhash.xxh3_64_intdigest(text, (doc_id or 0) & 0xFFFFFFFF) - (1 << 63)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part.column(0).to_pylist(), [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]


PLACES = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])
STRETCHES = pa.schema(
    [("key", pa.int64()), ("u", pa.binary()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("off", pa.int32())]
)
SPANS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in _batches(batches):
        hashes = [text_hash(i, t) for i, t in zip(ids, texts, strict=True)]
        yield _table(
            [
                (key, xxhash.xxh3_64_intdigest(texts[i][at : at + n + LENGTH - 1]) - (1 << 63), ids[i], hashes[i], at, n)
                for i, at, n, _, key in stretches(texts)
            ],
            PLACES,
        )


def _wanted(passes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches):
            found = list(stretches(texts))
            if not found:
                continue
            keep = np.flatnonzero(passes(np.array([f[4] for f in found], np.int64)))
            rows = [found[k] for k in keep]
            yield _table(
                [(key, texts[i][at : at + n + LENGTH - 1], ids[i], text_hash(ids[i], texts[i]), at, n, off) for i, at, n, off, key in rows], STRETCHES
            )

    return run


# ---- transforms of stretches that share anchors


class Transform:
    """Suffixes at the anchors of a shard of stretches, in order within their keys.

    ``left`` and ``right`` hold the symbols before (nearest first) and from the anchor on.
    """

    def __init__(self, group: np.ndarray, texts: list[bytes], off: np.ndarray):
        n = len(texts)
        self.group, self.off = group, off
        self.after = np.array([len(t) for t in texts]) - off
        self.right, self.left = np.zeros((n, LENGTH), np.uint8), np.zeros((n, LENGTH - PIECE), np.uint8)
        for r, (t, o) in enumerate(zip(texts, off.tolist(), strict=True)):
            b = np.frombuffer(t, np.uint8)
            self.right[r, : len(t) - o] = b[o:]
            self.left[r, :o] = b[:o][::-1]
        self.words = self.right.view(">u8").astype(np.uint64)
        self.order = np.lexsort((*self.words.T[::-1], group))


def merge(shards: list[Transform]) -> tuple[Transform, np.ndarray]:
    """The shards' suffixes as one transform, and the common prefix of each with the one before.

    The interleave starts as one block a key, shards one after another.  Iteration h refines
    each block by word h; blocks that hold suffixes of one shard are in order already.
    """
    whole = Transform.__new__(Transform)
    for name in ("group", "off", "after", "right", "left", "words"):
        setattr(whole, name, np.concatenate([getattr(s, name) for s in shards]))
    base = np.cumsum([0, *(len(s.group) for s in shards[:-1])])
    rows = np.concatenate([s.order + b for s, b in zip(shards, base, strict=True)])
    shard = np.repeat(np.arange(len(shards)), [len(s.group) for s in shards])
    place = np.argsort(whole.group[rows], kind="stable")
    rows = rows[place]
    block = np.cumsum(np.concatenate(([0], whole.group[rows][1:] != whole.group[rows][:-1])))
    for h in range(whole.words.shape[1]):
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        of = shard[rows]
        mixed = np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
        active = np.flatnonzero(np.repeat(mixed, np.diff(np.append(first, len(rows)))))
        if not len(active):
            break
        word = whole.words[rows[active], h]
        place = np.lexsort((word, block[active]))
        rows[active] = rows[active][place]
        word = word[place]
        inner = (block[active][1:] == block[active][:-1]) & (word[1:] != word[:-1])
        cut = np.concatenate(([False], block[1:] != block[:-1]))
        cut[active[1:]] |= inner
        block = np.cumsum(cut)
    whole.order = rows
    same = whole.right[rows[1:]] == whole.right[rows[:-1]]
    common = np.where(same.all(axis=1), LENGTH, (~same).argmax(axis=1))
    common = np.minimum(common, np.minimum(whole.after[rows[1:]], whole.after[rows[:-1]]))
    common[whole.group[rows[1:]] != whole.group[rows[:-1]]] = 0
    return whole, np.concatenate(([0], common))


def repeated_strings(group: np.ndarray, texts: list[bytes], off: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """For each stretch, which of its strings occur in another stretch of its key."""
    shards = [Transform(group[a : a + SHARD], texts[a : a + SHARD], off[a : a + SHARD]) for a in range(0, len(texts), SHARD)]
    whole, common = merge(shards)
    found = np.zeros((len(texts), LENGTH - PIECE + 1), np.bool_)  # by distance of the anchor
    rows, block = whole.order, np.cumsum(np.concatenate(([0], whole.group[whole.order][1:] != whole.group[whole.order][:-1])))
    nearest = off - n + 1  # the last string's distance from the anchor
    for left in range(LENGTH - PIECE + 1):
        if left:
            # one step of the LF-mapping, for the suffixes that have a symbol before
            keep = np.flatnonzero(off[rows] >= left)
            if not len(keep):
                break
            symbol = whole.left[rows[keep], left - 1]
            place = keep[np.lexsort((symbol, block[keep]))]
            symbol = whole.left[rows[place], left - 1]
            same = (block[place][1:] == block[place][:-1]) & (symbol[1:] == symbol[:-1])
            least = np.zeros(len(place), np.int64)
            if same.any():
                at = np.flatnonzero(same)
                bounds = np.stack([place[at] + 1, place[at + 1] + 1], axis=1).ravel()
                least[at + 1] = np.minimum.reduceat(np.append(common, 0), bounds)[::2] + 1
            rows, common = rows[place], least
            block = np.cumsum(np.concatenate(([0], ~same)))
            alone = np.concatenate(([True], ~same)) & np.concatenate((~same, [True]))
            rows, common, block = rows[~alone], common[~alone], block[~alone]
            if not len(rows):
                break
        # repeated intervals among the suffixes whose string here is in their stretch
        reach = np.flatnonzero(nearest[rows] <= left)
        if len(reach) < 2:
            continue
        bounds = np.stack([reach[:-1] + 1, reach[1:] + 1], axis=1).ravel()
        shared = np.minimum.reduceat(np.append(common, 0), bounds)[::2] >= LENGTH
        hit = np.concatenate((shared, [False])) | np.concatenate(([False], shared))
        found[rows[reach[hit]], left] = True
    return [found[r, o - np.arange(k)] for r, (o, k) in enumerate(zip(off.tolist(), n.tolist(), strict=True))]


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the repeated strings of stretches that come sorted by key."""
    names = ("key", "u", "doc_id", "text_hash", "start", "n", "off", "single")
    held: dict[str, list] = {c: [] for c in names}

    def done(upto: int) -> pa.RecordBatch:
        part = {c: v[:upto] for c, v in held.items()}
        for v in held.values():
            del v[:upto]
        _, group = np.unique(np.array(part["key"], np.int64), return_inverse=True)
        hits = repeated_strings(group, part["u"], np.array(part["off"], np.int64), np.array(part["n"], np.int64))
        spans = []
        for r, hit in enumerate(hits):
            if part["single"][r]:
                at = part["start"][r]
                spans += [(part["doc_id"][r], part["text_hash"][r], at + a, at + b - 1 + LENGTH) for a, b in runs(hit)]
        return _table(spans, SPANS)

    for batch in batches:
        for c in names:
            held[c] += batch.column(c).to_pylist()
        while len(held["key"]) > GATHER:
            keys = np.array(held["key"], np.int64)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            cuts = cuts[cuts <= GATHER] if len(cuts) and cuts[0] <= GATHER else cuts[:1]
            if not len(cuts):
                break
            yield done(int(cuts[-1]))
    if held["key"]:
        yield done(len(held["key"]))


HALVES = pa.schema([*STRETCHES, pa.field("single", pa.bool_()), pa.field("lo", pa.int32()), pa.field("hi", pa.int32())])


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stretch as those of its near and of its far strings (by distance lo to hi of the
    anchor), keyed by what all strings of such a half have in common."""
    for batch in batches:
        rows = []
        for key, u, doc_id, text_hash, start, n, off, single, lo, hi in zip(*(batch.column(c).to_pylist() for c in HALVES.names), strict=True):
            mid = (lo + hi) // 2
            for near, far in ((lo, mid), (mid + 1, hi)):
                first, last = max(0, off - far), min(n - 1, off - near)
                if near <= far and first <= last:
                    part = u[first : last + LENGTH]
                    core = u[off - near : off - far + LENGTH]
                    new = xxhash.xxh3_64_intdigest(core, (key ^ (near << 8) ^ far) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
                    rows.append((new, part, doc_id, text_hash, start + first, last - first + 1, off - first, single, near, far))
        yield _table(rows, HALVES)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, stop): spans, which may overlap, of repeated strings of ``docs`` (doc_id, text)."""
    places = stored(docs.mapInArrow(_places, ddl(PLACES)), "places")
    # aggregates that are joined back are tables of their own: broadcast if small, else joined with hot keys split
    often = stored(places.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "often")
    places = stored(places.join(often, "key"), "shared")
    contents = stored(places.groupBy("key", "content").agg(F.count("*").alias("c")), "contents")
    stop = (F.col("start") + F.col("n") - 1 + LENGTH).alias("stop")
    whole = places.join(contents.where("c > 1").select("key", "content"), ["key", "content"]).select("doc_id", "text_hash", "start", stop)

    several = stored(contents.groupBy("key").agg(F.count("*").alias("d")).where("d > 1").select("key"), "several")
    rows = docs.mapInArrow(_wanted(id_filter(several)), ddl(STRETCHES))
    rows = _distinct(rows.withColumns({"single": F.lit(True), "lo": F.lit(0), "hi": F.lit(LENGTH - PIECE)}))
    rows = stored(rows, "stretches")
    found = [whole]
    while True:
        sizes = stored(rows.groupBy("key").agg(F.count("*").alias("d")), "sizes")
        found.append(_spans(rows.join(sizes.where((F.col("d") > 1) & (F.col("d") <= MOST)).select("key"), "key")))
        hot = sizes.where(F.col("d") > MOST).select("key")
        if hot.isEmpty():
            break
        halves = stored(rows.join(hot, "key").select(*HALVES.names).mapInArrow(_halved, ddl(HALVES)), "halves")
        twice = halves.groupBy("key", "u").agg((F.count("*") > 1).alias("c"), F.bool_and("single").alias("s")).where("c OR NOT s").select("key", "u")
        found.append(halves.where("single").join(twice, ["key", "u"]).select("doc_id", "text_hash", "start", stop))
        rows = stored(_distinct(halves), "stretches")
    spans = found[0]
    for more in found[1:]:
        spans = spans.union(more)
    return spans


def _distinct(rows: DataFrame) -> DataFrame:
    """One row for equal stretches, ``single`` if it stands for one place only."""
    rest = [c for c in HALVES.names if c not in ("key", "u", "single")]
    one = rows.groupBy("key", "u").agg((F.bool_and("single") & (F.count("*") == 1)).alias("single"), *(F.min(c).alias(c) for c in rest))
    return one.select(*HALVES.names)


def _spans(rows: DataFrame) -> DataFrame:
    rows = rows.select("key", "u", "doc_id", "text_hash", "start", "n", "off", "single")
    return rows.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_merged, ddl(SPANS))


CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, the maximal runs of them."""
    left, at, n_runs, end = [], 0, 0, -1
    for a, b in sorted(spans):
        if a > end:
            left.append(text[at:a])
            n_runs += 1
        end = max(end, b)
        at = end
    left.append(text[at:])
    kept = b"".join(left)
    return kept, len(text) - len(kept), n_runs


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of ``docs``; kept is binary.

    ``digest`` gives kept_sha256, lowercase hexadecimal, in its place.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    spans = stored(repeated_spans(docs), "spans")
    hit = id_filter(spans.select("doc_id").distinct())
    last = pa.field("kept_sha256", pa.string()) if digest else CUT.field("kept")
    schema = pa.schema([*list(CUT)[:-1], last])
    kind = ddl(CUT).replace("kept binary", "kept_sha256 string") if digest else ddl(CUT)

    def row(doc_id, text, of):
        kept, gone, n = cut(text, of)
        return doc_id, len(text), gone, n, hashlib.sha256(kept).hexdigest() if digest else kept

    def hits(ids: list) -> np.ndarray:
        return hit(np.array([i or 0 for i in ids], np.int64)) | np.array([i is None for i in ids])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches):
            yield _table([row(i, t, ()) for i, t, h in zip(ids, texts, hits(ids), strict=True) if not h], schema)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches):
            rows = [(i, text_hash(i, t), t) for i, t, h in zip(ids, texts, hits(ids), strict=True) if h]
            yield _table(rows, pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("text", pa.binary())]))

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                each = zip(*(part.column(c).to_pylist() for c in ("id", "text", "spans")), strict=True)
                yield _table([row(i, t or b"", [(s["start"], s["stop"]) for s in of or ()]) for i, t, of in each], schema)

    lists = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    rows = docs.mapInArrow(touched, "id long, hash long, text binary")
    rows = rows.join(lists, rows["id"].eqNullSafe(lists["doc_id"]) & (rows["hash"] == lists["text_hash"]), "left").select("id", "text", "spans")
    return docs.mapInArrow(untouched, kind).union(rows.mapInArrow(cutting, kind))
