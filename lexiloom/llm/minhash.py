"""Near-duplicate documents by MinHash, banding and odd sketches.

A document's set is its distinct 5-word shingles.  One pass over the texts gives for
each document the size and a 128-bit hash of its set, 100 MinHash samples folded into
20 band keys of 5, and the samples' *odd sketch*: a bitmap in which every sample flips
one bit, so that the XOR of two sketches counts the samples that differ.

1. Documents with equal sets collapse to one vertex, the smallest ``doc_id``.
2. In every band bucket each vertex meets the bucket's smallest (an aggregation and a
   join, no group is gathered), and their sketches are compared.  Buckets in which all
   agree with the smallest are settled by those stars; the others are compared by sketch
   in blocks, which give a spanning forest of what agrees.  The slack of five standard
   deviations lets no pair at the threshold go.
3. The connected components of that are *candidate clusters*: two vertices that share a
   band and may be linked are in one.  The texts of clustered documents alone are moved
   (a Bloom filter of their ids, of bounded size, keeps the rest where it is), each once,
   to its cluster, whose members are confirmed on their full sets, all against all by
   matrix products within a task.  A task returns a spanning forest of its confirmed links,
   no pair list.
4. Clusters of more than BLOCK members or BLOCK_BYTES of text are confirmed head first: each
   member meets the cluster's first member, then the one that is most similar to that, which
   tells its distance to both.  Members linked with neither are *left*; only they, in blocks,
   meet all members.  A pair whose distances to one of the heads are further apart than a link
   allows (1 - similarity is a metric) is not compared.  A task holds a block of left sets,
   bounded by members and bytes, and one more text.  A cluster of n members around a common
   text moves each text three times; one of n members that no head reaches moves n texts for
   each block of them.

Nothing is lost beyond what banding misses: a pair at the threshold escapes all bands
with probability 8e-6.

Texts may be of any length; a set takes eight bytes a word while it is compared.  Only doc_id
and text are read, so other columns may have any name.

Defined results: texts without a word have an empty set, size 0, and are linked with
nothing; texts of fewer than five words are one shingle, their whole sequence; rows that
share a ``doc_id`` are one vertex; a null ``doc_id`` is linked with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.bloom import id_filter
from lexiloom.llm.common import slices, stored
from lexiloom.llm.components import connected_components
from lexiloom.llm.groups import Forest, grouped

WIDTH = 5
BANDS, ROWS = 20, 5
SKETCH_BITS = 512
#: Estimated similarity (per cent) below the threshold at which a pair is still confirmed:
#: five standard deviations of 100 samples at a similarity of 0.85.
SLACK = 18
#: Members of a bucket or cluster, and bytes of their texts, that are compared in one task.
BLOCK, BLOCK_BYTES = 256, 32 << 20
#: Members that meet a head, or a block of left ones, in one task.
SLICE = 4096
#: Columns of the products of sets.
COLUMNS = 4096
#: Shingles hashed at a time, so that the arrays stay in the processor's cache.
CHUNK = 1 << 15
CACHED_WORDS = 1 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """Hashes of words, kept up to a bounded number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The document's set as sorted 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - WIDTH + 1)
    width = len(words) - n + 1
    x = np.full(n, width, np.uint64)
    for i in range(width):
        x = _mixed(x * _PRIME + h[i : i + n])
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.Generator(np.random.PCG64(20_231))
    full = np.iinfo(np.uint64).max
    xor = drawn.integers(0, full, BANDS * ROWS, np.uint64, endpoint=True)
    odd = drawn.integers(0, full, BANDS * ROWS, np.uint64, endpoint=True) | np.uint64(1)
    return xor, odd


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, a row for each (not empty) set."""
    xor, odd = _permutations()
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    at = 0
    while at < len(sets):
        end, n = at, 0
        while end < len(sets) and (end == at or n + len(sets[end]) <= CHUNK):
            n += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        for k in range(BANDS * ROWS):
            out[at:end, k] = np.minimum.reduceat((x ^ xor[k]) * odd[k], starts)
        at = end
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    keys = np.empty((len(mins), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(mins), b + 1, np.uint64)
        for r in range(ROWS):
            x = _mixed(x * _PRIME + mins[:, b * ROWS + r])
        keys[:, b] = x
    return keys.view(np.int64)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """One row of SKETCH_BITS / 64 longs for each row of samples."""
    place = _mixed(mins * _PRIME + np.arange(mins.shape[1], dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    parity = np.zeros((len(mins), SKETCH_BITS), np.uint8)
    rows = np.arange(len(mins))
    for k in range(mins.shape[1]):
        parity[rows, place[:, k]] ^= 1
    return np.packbits(parity, axis=1).view(np.int64)


def most_odd_bits(percent: float) -> int:
    """Odd bits that sketches of sets of at least this similarity (less SLACK) may differ in.

    With d of the samples unequal, 2 d bits are flipped: expected odd bits are
    ``n (1 - (1 - 2 / n) ** (2 d)) / 2``; four standard deviations come on top.
    """
    flips = 2 * BANDS * ROWS * (1 - max(0.0, percent - SLACK) / 100)
    mean = SKETCH_BITS * (1 - (1 - 2 / SKETCH_BITS) ** flips) / 2
    return int(mean + 4 * mean**0.5)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(t, hashes) for t in part.column("text").to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            odd: list = [None] * len(sets)
            if some:
                mins = samples([sets[i] for i in some])
                for i, k, o in zip(some, band_keys(mins), odd_sketches(mins), strict=True):
                    keys[i], odd[i] = k, o
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(odd, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_hash", "bands", "sketch"],
            )


SIGNED = "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch array<long>"


PAIR = "a long, b long"


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(r) for r in rows], pa.int64()), pa.array([max(r) for r in rows], pa.int64())], ["a", "b"])


def _by_sketch(percent: float):
    """A spanning forest of the vertices of each (bucket, pair of blocks) whose sketches agree."""
    most = most_odd_bits(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["key", "i", "j"]):
            v = rows.column("v").to_numpy()
            # unsigned: the bit count of a negative number is that of its absolute value
            sketch = np.array(rows.column("sketch").to_pylist(), np.int64).view(np.uint64)
            forest = Forest(len(v))
            for x in range(len(v) - 1):
                near = np.bitwise_count(sketch[x + 1 :] ^ sketch[x]).sum(1) <= most
                for y in np.flatnonzero(near):
                    forest.join(x, x + 1 + int(y))
            if forest.links:
                yield _pairs([(int(v[x]), int(v[y])) for x, y in forest.links])

    return run


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets, each confirmed in full."""
    forest, size = Forest(len(sets)), np.array([len(s) for s in sets])
    if len(sets) <= 8:
        for x in range(len(sets)):
            for y in range(x):
                if forest.find(x) != forest.find(y):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= percent * (size[x] + size[y] - both):
                        forest.join(y, x)
        return forest.links
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    for at in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        both += part @ part.T
    x, y = np.nonzero(100 * both >= percent * (size[:, None] + size[None, :] - both))
    for p, q in zip(x[x < y].tolist(), y[x < y].tolist(), strict=True):
        forest.join(p, q)
    return forest.links


def _by_set(percent: int):
    """A spanning forest of the confirmed links of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for rows in grouped(batches, ["cluster"]):
            v = rows.column("v").to_numpy()
            links = linked([shingles(t.as_py(), hashes) for t in rows.column("text")], percent)
            if links:
                yield _pairs([(int(v[x]), int(v[y])) for x, y in links])

    return run


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Members that two sorted sets share."""
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)) if len(a) and len(b) else 0


HEADED = "cluster long, v long, t long, head long, similar double, near boolean"


def _with_head(percent: int):
    """Each member's similarity to the head, which comes first of its (cluster, slice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        cluster, head_id, head = None, 0, np.empty(0, np.uint64)
        for batch in slices(batches):
            out = []
            columns = (batch.column(c).to_pylist() for c in ("cluster", "is_head", "v", "t"))
            for k, (c, is_head, v, t) in enumerate(zip(*columns, strict=True)):
                x = shingles(batch.column("text")[k].as_py(), hashes)
                if is_head:
                    cluster, head_id, head = c, v, x
                elif c == cluster:
                    both = _overlap(x, head)
                    union = len(x) + len(head) - both
                    out.append((c, v, t, head_id, both / union, 100 * both >= percent * union))
            columns = zip(*out, strict=True) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["cluster", "v", "t", "head", "similar", "near"])

    return run


def _left_ones(percent: int):
    """A spanning forest of the links of each (cluster, block, slice): its left members, which come
    first, and the members of the slice."""
    apart = 1 - percent / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        key, left, near, far = None, [], [], []
        holder = shingle = size = np.empty(0)
        place: dict[int, int] = {}
        forest, ids = Forest(0), []
        ready = False
        for batch in slices(batches):
            links: list[tuple[int, int]] = []
            names = ("cluster", "block", "slice", "is_left", "v", "first", "second")
            for k, (c, b, s, is_left, v, d1, d2) in enumerate(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
                if (c, b, s) != key:
                    key, left, near, far, ids, place, ready = (c, b, s), [], [], [], [], {}, False
                x = shingles(batch.column("text")[k].as_py(), hashes)
                if is_left:
                    place[v] = len(ids)
                    ids.append(v)
                    left.append(x)
                    near.append(d1)
                    far.append(d2)
                    continue
                if not ready:
                    holder = np.repeat(np.arange(len(left)), [len(y) for y in left])
                    shingle = np.concatenate(left) if left else np.empty(0, np.uint64)
                    order = np.argsort(shingle, kind="stable")
                    holder, shingle, size = holder[order], shingle[order], np.array([len(y) for y in left])
                    first, second = np.array(near, float), np.array(far, float)
                    forest, ready = Forest(len(left)), True
                    n_left = len(left)
                    left = []
                if not n_left:
                    continue
                may = (np.abs(first - d1) <= apart) & (np.abs(second - d2) <= apart)
                if place.get(v, n_left) < n_left:
                    may[place[v]] = False
                if not may.any():
                    continue
                a, z = np.searchsorted(shingle, x), np.searchsorted(shingle, x, side="right")
                at = np.repeat(a - np.concatenate(([0], np.cumsum(z - a)[:-1])), z - a) + np.arange((z - a).sum())
                both = np.bincount(holder[at], minlength=n_left)
                hit = np.flatnonzero(may & (100 * both >= percent * (size + len(x) - both)))
                if not len(hit):
                    continue
                if v in place:
                    me = place[v]
                else:
                    me = place[v] = len(ids)
                    ids.append(v)
                    forest.up.append(me)
                for y in hit.tolist():
                    forest.join(me, y)
                links += [(ids[p], ids[q]) for p, q in forest.links]
                forest.links.clear()
            if links:
                yield _pairs(links)

    return run


def _head_first(rows: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """HEADED: members of clusters (cluster, v, t, text, n_slices) and their similarity to ``heads`` (cluster, v)."""
    slice_ = F.pmod(F.xxhash64("v"), F.col("n_slices")).cast("int")
    head = rows.join(heads.select(F.col("cluster").alias("_c"), F.col("v").alias("_v")), (F.col("cluster") == F.col("_c")) & (F.col("v") == F.col("_v")), "left_semi")
    head = head.select("cluster", "v", "t", "text", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)).alias("slice"), F.lit(True).alias("is_head"))
    both = head.union(rows.select("cluster", "v", "t", "text", slice_.alias("slice"), F.lit(False)))
    both = both.repartition("cluster", "slice").sortWithinPartitions("cluster", "slice", F.desc("is_head"))
    return both.mapInArrow(_with_head(percent), HEADED)


def _large_clusters(rows: DataFrame, percent: int) -> DataFrame:
    """Links that span the components within large clusters (cluster, v, text, n_slices)."""
    # rows that share an id are one vertex; their texts are told apart by a hash
    rows = stored(rows.withColumn("t", F.xxhash64("text")).dropDuplicates(["cluster", "v", "t"]), "members")
    first = stored(_head_first(rows, rows.groupBy("cluster").agg(F.min("v").alias("v")), percent), "headed")
    others = first.where("v <> head")
    second = others.groupBy("cluster").agg(F.max_by("v", F.struct("near", "similar", -F.col("v"))).alias("v"))
    second = stored(_head_first(rows, second, percent), "headed")
    links = others.where("near").select(F.least("v", "head").alias("a"), F.greatest("v", "head").alias("b"))
    links = links.union(second.where("near AND v <> head").select(F.least("v", "head"), F.greatest("v", "head")))

    told = first.select("cluster", "v", "t", (1 - F.col("similar")).alias("first"), F.col("near").alias("_near"), F.col("head").alias("_head")).join(
        second.select("cluster", "v", "t", (1 - F.col("similar")).alias("second"), F.col("near").alias("_also"), F.col("head").alias("_next")), ["cluster", "v", "t"]
    )
    told = stored(told.withColumn("is_left", ~(F.col("_near") | F.col("_also"))).drop("_near", "_also", "_head", "_next"), "told")
    known = rows.join(told, ["cluster", "v", "t"])
    sums = known.where("is_left").groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = stored(sums.select(F.col("cluster").alias("_c"), F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("n_blocks")), "blocks")
    known = known.join(blocks, F.col("cluster") == F.col("_c")).drop("_c")
    kept = ["cluster", "block", "slice", "is_left", "v", "first", "second", "text"]
    held = known.where("is_left").withColumn("block", F.pmod(F.xxhash64("v", F.lit("left")), F.col("n_blocks")).cast("int"))
    held = held.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)))
    met = known.withColumn("slice", F.pmod(F.xxhash64("v"), F.col("n_slices")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    both = held.select(*kept).union(met.withColumn("is_left", F.lit(False)).select(*kept))
    both = both.repartition("cluster", "block", "slice").sortWithinPartitions("cluster", "block", "slice", F.desc("is_left"))
    return links.union(both.mapInArrow(_left_ones(percent), PAIR))


def _in_blocks(rows: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """Rows of every group, dealt to the pairs of its blocks: columns i and j, sorted groups.

    A group of one block is one pair, (0, 0); in larger ones only pairs of different blocks
    are made, each of which compares the rows within its blocks as well.
    """
    n = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.join(sizes.select(key, n.alias("n_blocks")), key)
    block = F.pmod(F.xxhash64("v"), F.col("n_blocks")).cast("int")
    others = F.when(F.col("n_blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("n_blocks") - 1), block))
    rows = rows.withColumn("block", block).withColumn("other", F.explode(others))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("block", "other", "n_blocks")
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    signed = stored(docs.mapInArrow(_signed, SIGNED), "signed")
    full = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    vertices = stored(
        full.groupBy("set_hash").agg(F.min("doc_id").alias("v"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "vertices"
    )
    equal = full.select("doc_id", "set_hash").join(vertices.select("set_hash", "v"), "set_hash").where("doc_id <> v")
    equal = equal.select(F.col("doc_id").alias("a"), F.col("v").alias("b"))

    component = connected_components(equal.union(confirmed(candidates(vertices, percent), docs, percent)))
    found = signed.select("doc_id", "n_shingles").join(component.toDF("doc_id", "component_id"), "doc_id", "left")
    found = found.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return found.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def candidates(vertices: DataFrame, percent: int) -> DataFrame:
    """(a, b) that span the candidate clusters of ``vertices`` (v, bands, sketch)."""
    sketches = vertices.select("v", "sketch")
    bands = vertices.select("v", F.explode("bands").alias("key"))
    heads = bands.groupBy("key").agg(F.min("v").alias("head"), F.max("v").alias("last"), F.count("*").alias("n")).where("head <> last")
    shared = stored(bands.join(heads.select("key", "head", "n"), "key"), "buckets")
    stars = shared.where("v <> head").select(F.col("head").alias("a"), F.col("v").alias("b")).distinct()
    stars = stars.join(sketches.toDF("a", "x"), "a").join(sketches.toDF("b", "y"), "b")
    odd = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    stars = stored(stars.select("a", "b", (odd <= most_odd_bits(percent)).alias("near")), "stars")
    far = stars.where("NOT near").select("a", "b")
    open_keys = shared.join(far, (F.col("head") == F.col("a")) & (F.col("v") == F.col("b"))).select("key", "n").distinct()
    rows = shared.select("key", "v").join(open_keys.select("key"), "key").join(sketches, "v")
    rest = _in_blocks(rows, "key", open_keys).mapInArrow(_by_sketch(percent), PAIR)
    return stars.where("near").select("a", "b").union(rest)


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that span the same components as all links within the clusters do."""
    clusters = stored(connected_components(pairs).toDF("v", "cluster"), "clusters")
    passes = id_filter(clusters.select("v"))

    def clustered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            yield batch.filter(pa.array(passes(batch.column("doc_id").to_numpy())))

    texts = docs.mapInArrow(clustered, "doc_id long, text string").withColumnRenamed("doc_id", "v")
    texts = stored(texts.join(clusters, "v").select("v", "cluster", "text"), "clustered")
    sizes = texts.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = stored(sizes.where((F.col("n") > BLOCK) | (F.col("bytes") > BLOCK_BYTES)).select("cluster", F.ceil(F.col("n") / SLICE).cast("int").alias("n_slices")), "large")
    small = texts.join(large, "cluster", "left_anti").repartition("cluster").sortWithinPartitions("cluster")
    links = small.mapInArrow(_by_set(percent), PAIR)
    if not large.isEmpty():
        links = links.union(_large_clusters(texts.join(large, "cluster"), percent))
    return stored(links, "links")


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one document, the smallest ``doc_id``, of each group left."""
    gone = near_duplicates(docs, percent).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")
