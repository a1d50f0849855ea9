"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal updates.

Features of a text are the unigrams and bigrams of its words and of their shapes (case,
length, signs), and the bigram of any word twice, hashed into ``2 ** BITS`` slots; slot values are square roots of counts,
scaled to unit length.  Training makes ``PASSES`` passes over at most ``MOST_ROWS``
labelled texts, chosen by hash (the documented bound), in one task: follow-the-
regularised-leader keeps per slot a gradient sum z and a squared sum n, and its L1 term
leaves the weights sparse.  Scoring is a sparse dot product for every document, with the
weights (at most 8 MB, fixed by BITS) broadcast.

Defined results: null and blank texts score by the intercept alone; without a labelled
row every score is 0.5; labels that are null, or of a null id, are not learnt from; a null id
is scored like any other; rows that repeat are scanned each by itself and score alike, and
equal texts score equally; ties of the hash are ordered by id, label and text; a text of any
length is read whole, its features in memory; only doc_id and text are read, so other columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 20
PASSES = 4
MOST_ROWS = 8_000
#: Learning rate, its smoothing, and the penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1e-4
CACHED_WORDS = 200_000
#: The hash of a bigram of one word twice, whichever word it is.
AGAIN = np.uint64(0xA24BAED4963EE407)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    """Word to the hashes of itself and of its shape: letters, caps, signs at its end."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        kept = "".join(c for c in word if not c.isalnum())
        case = "U" if len(word) > 1 and word.isupper() else "l" if word.islower() else "m"
        shape = f"{case}{min(len(word), 12)}{kept[:8]}"
        made = xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(shape, 1)
        self[word] = made
        return made


def features(text: str | None, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Slots and their values, unit length; both empty for a text without words."""
    found = [words[w] for w in (text or "").split()]
    if not found:
        return np.empty(0, np.int64), np.empty(0)
    h = np.array(found, np.uint64)
    word, shape = h[:, 0], h[:, 1]
    pairs = _mixed(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:])
    shapes = _mixed(shape[:-1] * np.uint64(0xD6E8FEB86659FD93) + shape[1:])
    again = np.full(np.count_nonzero(word[1:] == word[:-1]), AGAIN)
    all_slots = np.concatenate((word, pairs, shape, shapes, again)) >> np.uint64(64 - BITS)
    slots, counts = np.unique(all_slots.astype(np.int64), return_counts=True)
    values = np.sqrt(counts)
    return slots, values / np.sqrt((values**2).sum())


class Ftrl:
    """FTRL-proximal for logistic loss; slot ``2 ** BITS`` is the intercept, not penalised."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, slots: np.ndarray) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        l1 = np.where(slots == 1 << BITS, 0.0, L1)
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        slots, values = np.append(slots, 1 << BITS), np.append(values, 1.0)
        w = self.weights(slots)
        g = (_sigmoid(w @ values) - label) * values
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[slots] += g * g

    def all_weights(self) -> np.ndarray:
        return self.weights(np.arange((1 << BITS) + 1))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights learnt from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, label) names.

    At most MOST_ROWS labels are taken, by the hash of their ids, and broadcast; of the texts
    that they name, more than one where ids repeat, at most MOST_ROWS are learnt from.  The
    order of learning is by a hash of the texts, so reruns agree.
    """
    drawn = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("label").cast("int").alias("label"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(MOST_ROWS)
    sample = docs.join(F.broadcast(drawn), "doc_id").select("text", "label").orderBy(F.xxhash64("text", "label"), "text").limit(MOST_ROWS)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows = _Words(), []
        for batch in batches:
            for t, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                slots, values = features(t.as_py(), words)
                rows.append((slots.astype(np.int32), values.astype(np.float32), label))
        model = Ftrl()
        for _ in range(PASSES):
            for slots, values, label in rows:
                model.learn(slots.astype(np.int64), values.astype(np.float64), label)
        w = model.all_weights()
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(w[some])], ["slot", "w"])

    learnt = sample.coalesce(1).mapInArrow(fit, "slot long, w double").toArrow()
    weights = np.zeros((1 << BITS) + 1)
    weights[learnt.column("slot").to_numpy()] = learnt.column("w").to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, words = shared.value, _Words()
        for batch in batches:
            out = []
            for t in batch.column(1):
                slots, values = features(t.as_py(), words)
                out.append(float(_sigmoid(w[slots] @ values + w[-1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, score double")
