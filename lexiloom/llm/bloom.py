"""A Bloom filter over ids, built in parts and broadcast at a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits at most: 32 MB, the proven bound of what is broadcast.  A filter that fills up
#: lets more rows through and never loses one.
MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
CHUNK_BYTES = 1 << 13


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    mask = np.uint64(bits - 1)
    return np.stack([x & mask, (x >> np.uint64(32)) & mask], axis=1).astype(np.int64)


class IdFilter:
    """Tests arrays of ids; made by ``id_filter``."""

    def __init__(self, shared, bits: int):
        self.shared, self.bits = shared, bits

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        at = _places(ids, self.bits)
        filled = np.frombuffer(self.shared.value, np.uint8)
        return ((filled[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def id_filter(ids: DataFrame) -> IdFilter:
    """A filter of the one long column of ``ids``, null ids left out."""
    name = ids.columns[0]
    n = ids.count()
    bits = 1 << (max(MIN_BITS, min(MAX_BITS, 16 * n)) - 1).bit_length()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = _places(batch.column(0).drop_null().to_numpy(), bits).ravel()
            np.bitwise_or.at(filled, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        chunks = filled.reshape(-1, CHUNK_BYTES)
        some = np.flatnonzero(chunks.any(axis=1))
        for k in range(0, len(some), 256):
            part = some[k : k + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([chunks[i].tobytes() for i in part], pa.binary())], ["chunk", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(part, np.uint8)
                held[k] = held[k] | part if k in held else part
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["chunk", "bits"])

    kind = "chunk int, bits binary"
    parts = ids.select(F.col(name).cast("long")).mapInArrow(fill, kind).repartition(F.col("chunk")).mapInArrow(unite, kind)
    filled = np.zeros(bits // 8, np.uint8)
    for row in parts.collect():  # at most MAX_BITS / 8 bytes
        filled[row.chunk * CHUNK_BYTES :][: len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return IdFilter(ids.sparkSession.sparkContext.broadcast(filled.tobytes()), bits)
