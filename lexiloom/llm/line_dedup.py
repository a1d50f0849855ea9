"""Repeated lines, found with two Bloom filters and confirmed exactly.

A line's key is the line without blanks at its ends, A-Z lower-cased.  One pass over the
texts fills, in every task, a filter of keys seen in one document and a filter of keys
seen in two; the tasks' filters travel as small chunks and are united chunk by chunk
(seen twice: in one task, or once in two of them).  Only keys that the *twice* filter
holds are shuffled, as 128-bit hashes, for the exact count of documents and the choice
of the first; the rest of the lines never move.

The filters have a power of two of bits, about 16 for every line expected and at most
``MAX_BITS`` (32 MB each), the proven bound of what is broadcast.  Beyond some 16 million
lines they fill up and more keys are shuffled; results stay exact.

Defined results: null and empty texts are one empty line; a key counts once a document;
rows with equal ``doc_id`` are documents of their own when counted; other columns pass
through, and the columns ``n_lines`` and ``n_dropped`` replace any of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import slices, stored

BLANK = b" \t\n\x0b\x0c\r"
MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
CHUNK_BYTES = 1 << 13
#: Bytes of text for every bit of a filter: lines are some 300 bytes long.
BYTES_PER_BIT = 16
HASHES = 2


def keys_of(text: str | None) -> list[bytes]:
    """The key of every line."""
    return [line.strip(BLANK) for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def places(keys: set[bytes], bits: int) -> np.ndarray:
    """HASHES bit places for each key: a row for each."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    mask = np.uint64(bits - 1)
    return np.stack([(h >> np.uint64(32 * k)) & mask for k in range(HASHES)], axis=1).astype(np.int64)


class Bloom:
    """A pair of packed filters: keys added once, keys added twice or more."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    def add(self, keys: set[bytes]) -> None:
        """Adds one document's distinct keys."""
        if not keys:
            return
        at = places(keys, self.bits)
        seen = holds(self.once, at)
        for filled, new in ((self.twice, at[seen].ravel()), (self.once, at[~seen].ravel())):
            np.bitwise_or.at(filled, new >> 3, np.uint8(128) >> (new & 7).astype(np.uint8))

    def chunks(self) -> Iterator[tuple[int, bytes, bytes]]:
        for k in range(0, len(self.once), CHUNK_BYTES):
            if (part := self.once[k : k + CHUNK_BYTES]).any():
                yield k // CHUNK_BYTES, part.tobytes(), self.twice[k : k + CHUNK_BYTES].tobytes()


def holds(filled: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row of places whether all of its bits are set."""
    return ((filled[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=1)


CHUNKS = "chunk int, once binary, twice binary"


def _fill(bits: int, min_chars: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(bits)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                bloom.add({k for k in keys_of(text) if len(k.decode("utf-8", "surrogatepass")) >= min_chars})
        rows = list(bloom.chunks())
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in part], pa.int32()), *(pa.array([r[i] for r in part], pa.binary()) for i in (1, 2))], ["chunk", "once", "twice"]
            )

    return fill


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites the chunks of a partition as they come: two arrays for each chunk are held."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for k, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            one, two = np.frombuffer(once, np.uint8), np.frombuffer(twice, np.uint8)
            if k in held:
                a, b = held[k]
                held[k] = a | one, b | two | (a & one)
            else:
                held[k] = one, two
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), *(pa.array([v[i].tobytes() for v in held.values()], pa.binary()) for i in (0, 1))], ["chunk", "once", "twice"]
        )


def filter_bits(n_bytes: int) -> int:
    want = max(MIN_BITS, min(MAX_BITS, n_bytes // BYTES_PER_BIT))
    return 1 << (want - 1).bit_length()


def suspects(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(doc_id, key) for the lines that may occur in two documents: never fewer."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = filter_bits(n_bytes)
    parts = docs.select("text").mapInArrow(_fill(bits, min_chars), CHUNKS)
    united = parts.repartition(F.col("chunk")).mapInArrow(_unite, CHUNKS)
    twice = np.zeros(bits // 8, np.uint8)
    for row in united.select("chunk", "twice").collect():  # at most MAX_BITS / 8 bytes
        at = row.chunk * CHUNK_BYTES
        twice[at : at + len(row.twice)] = np.frombuffer(row.twice, np.uint8)
    shared = spark.sparkContext.broadcast(twice.tobytes())

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(shared.value, np.uint8)
        for batch in slices(batches):
            ids, keys = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = [k for k in set(keys_of(text)) if len(k.decode("utf-8", "surrogatepass")) >= min_chars]
                if found:
                    hit = holds(filled, places(found, bits))
                    new = [xxhash.xxh3_128_digest(found[j]) for j in np.flatnonzero(hit)]
                    keys += new
                    ids += [i] * len(new)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return docs.select("doc_id", "text").mapInArrow(suspected, "doc_id long, key binary")


def _dropped(columns: list[str], min_chars: int):
    def dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, n, gone = [], [], []
            for text, keys, first in zip(*(batch.column(c).to_pylist() for c in ("text", "_keys", "_first")), strict=True):
                lines = (text or "").split("\n")
                n.append(len(lines))
                if not keys:
                    texts.append(text or "")
                    gone.append(0)
                    continue
                drop, keep = set(keys), set(first or ())
                left = []
                for line, key in zip(lines, keys_of(text), strict=True):
                    h = xxhash.xxh3_128_digest(key) if len(key.decode("utf-8", "surrogatepass")) >= min_chars else None
                    if h is None or h not in drop or h in keep:
                        left.append(line)
                        keep.discard(h)
                texts.append("\n".join(left))
                gone.append(len(lines) - len(left))
            rest = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*columns, "text", "n_lines", "n_dropped"])

    return dropped


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` with text without the lines found in ``min_docs`` documents, n_lines, n_dropped.

    With ``keep_first`` the first line of that key stays in the document of the smallest
    ``doc_id`` that has it.
    """
    if min_docs < 2:
        raise ValueError("a line is repeated in two documents at least: the filters know no fewer")
    docs = docs.drop("n_lines", "n_dropped", "_keys", "_first")
    found = stored(suspects(docs.select(F.col("doc_id").cast("long"), "text"), min_chars), "suspects")
    # a table of its own, so that the join may broadcast it or split the commonest lines' rows
    often = found.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") >= min_docs)
    often = stored(often, "often")
    hits = found.join(often, "key")
    first = F.when(F.lit(keep_first) & (F.col("doc_id") == F.col("first")), F.col("key"))
    of = hits.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("key").alias("_keys"), F.collect_set(first).alias("_first"))
    joined = docs.join(of, docs["doc_id"].cast("long").eqNullSafe(F.col("_id")), "left").drop("_id")
    columns = [c for c in docs.columns if c != "text"]
    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return joined.mapInArrow(_dropped(columns, min_chars), f"{made}, text string, n_lines long, n_dropped long")
