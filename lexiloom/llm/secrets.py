"""Secret scans through a stored trigram index over regular expressions.

1. ``index`` writes postings of every trigram of every text, in segments: for each segment of
   up to SEGMENT texts a row a trigram with the sorted places of the texts that hold it, and a
   row with the texts' keys.  It is made once, without a shuffle, whatever the rules.
2. From every rule's pattern a Boolean query over trigrams is derived that each match must
   satisfy: a literal run of three characters or more gives the AND of its trigrams, an
   alternation the OR of its branches, anything else nothing.
3. ``candidates`` reads the postings of the rules' trigrams alone (a filter that reaches the
   scan of the index), intersects and unites them segment by segment, and gives the keys of
   the texts left, with the rules that each is left for.
4. ``find_secrets`` verifies: candidates' texts meet their rules and are scanned with those
   patterns.  A Bloom filter of the candidates' keys, of bounded size, keeps other texts where
   they are.  A rule without a mandatory trigram, such as a run of hexadecimal digits, scans
   every text on the way.

A text's key is a hash of its id and content, so rows that agree in both share it and are
scanned alike.  A segment's postings are what a task holds, some megabytes, and one text.

Defined results: null text is empty and has no span; spans count code points, ends are
exclusive; a span of one kind never hides one of another kind, spans of one start are ordered
by the rules' order; repeated rows are scanned each by itself; a null id passes through; only
doc_id and text are read, so other columns may have any name.  Texts may have any length:
the patterns are searched in time that grows with the text's length alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from re import _constants as op  # type: ignore[attr-defined]
from re import _parser as parser  # type: ignore[attr-defined]

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.bloom import id_filter
from lexiloom.llm.common import slices, stored
from lexiloom.llm.groups import grouped

#: Texts and bytes of a segment, at most (a longer text is a segment of its own).
SEGMENT, SEGMENT_BYTES = 4096, 16 << 20
#: Branches that a query may grow to before it is given up for a scan.
MOST_BRANCHES = 64
#: The row of a segment that holds the keys instead of a posting.
KEYS = -1


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    flags: int = re.ASCII

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost matches that do not overlap; those too short are dropped afterwards."""
        return [m.span() for m in self.regex.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: The kinds of the contract, then formats that vendors publish.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{60,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    # only from the start of a run: within one, every "eyJ" would read it again to its end
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)


# A query is None (matches everything), a trigram, or ("and" | "or", frozenset of queries).


def trigram_query(pattern: str, flags: int = re.ASCII):
    """The trigrams, lower-cased, that any match of ``pattern`` holds; None if none is sure.

    Postings are of lower-cased text: a superset for patterns that mind the case.
    """
    return _all(_walk(parser.parse(pattern, flags)))


def _walk(seq) -> list:
    """Conditions of a sequence; runs of literals are cut into trigrams."""
    found, run = [], [""]

    def flush() -> None:
        found.append(_any([_literal(r) for r in run]))
        run[:] = [""]

    for kind, arg in seq:
        if kind is op.LITERAL:
            run[:] = [r + chr(arg).lower() for r in run]
        elif kind is op.SUBPATTERN:
            branches = _strings(arg[-1])
            if branches and len(branches) * len(run) <= MOST_BRANCHES:
                run[:] = [r + b for r in run for b in branches]
            else:
                flush()
                found += _walk(arg[-1])
        elif kind is op.BRANCH:
            flush()
            found.append(_any([_all(_walk(b)) for b in arg[1]]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
            flush()
            found += _walk(arg[2])
        else:
            branches = _strings([(kind, arg)])
            if branches and len(branches) * len(run) <= MOST_BRANCHES:
                run[:] = [r + b for r in run for b in branches]
            else:
                flush()
    flush()
    return found


def _strings(seq) -> list[str] | None:
    """All strings of a small finite piece; None for any other."""
    made = [""]
    for kind, arg in seq:
        if kind is op.LITERAL:
            more = [chr(arg).lower()]
        elif kind is op.SUBPATTERN:
            more = _strings(arg[-1])
        elif kind is op.BRANCH:
            parts = [_strings(b) for b in arg[1]]
            more = None if None in parts else [s for p in parts for s in p]
        elif kind is op.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
            inner = _strings(arg[2])
            more = None if inner is None else ["", *inner]
        elif kind is op.IN and all(k is op.LITERAL for k, _ in arg):
            more = [chr(a).lower() for _, a in arg]
        else:
            more = None
        if more is None or len(made) * len(more) > MOST_BRANCHES:
            return None
        made = [m + s for m in made for s in more]
    return made


def _literal(run: str):
    # the lower case of a few letters outside ASCII has another length: never rely on those
    return _all([run[i : i + 3] for i in range(len(run) - 2) if run[i : i + 3].isascii()])


def _all(parts):
    parts = frozenset(p for p in parts if p is not None)
    return None if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def _any(parts):
    parts = frozenset(parts)
    return None if None in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", parts)


def trigrams_of(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def code(trigram: str) -> int:
    """A trigram of ASCII characters as a number."""
    return int.from_bytes(trigram.encode("ascii"), "big")


def codes_of(text: bytes) -> np.ndarray:
    """The distinct trigrams of a text's bytes, A-Z lower-cased, as sorted numbers."""
    b = np.frombuffer(text.lower(), np.uint8)
    if len(b) < 3:
        return np.empty(0, np.int32)
    found = (b[:-2].astype(np.int32) << 16) | (b[1:-1].astype(np.int32) << 8) | b[2:]
    found.sort()
    return found[np.concatenate(([True], found[1:] != found[:-1]))]


def key_of(doc_id, text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text, xxhash.xxh3_64_intdigest(repr(doc_id))) - (1 << 63)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[int]]]:
    """Rows (doc_id, text), their texts in UTF-8 and keys, some at a time."""
    for batch in slices(batches):
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield batch, texts, [key_of(i, t) for i, t in zip(batch.column(0).to_pylist(), texts, strict=True)]


INDEX = pa.schema([("segment", pa.int64()), ("gram", pa.int32()), ("places", pa.binary())])


def packed(places: np.ndarray, n: int) -> bytes:
    """A posting of a segment of n texts: 16-bit places or, where shorter, a bit for each text."""
    if 16 * len(places) <= n:
        return b"p" + places.astype("<u2").tobytes()
    bits = np.zeros(n, np.uint8)
    bits[places] = 1
    return b"b" + np.packbits(bits).tobytes()


def unpacked(posting: bytes) -> np.ndarray:
    if posting[:1] == b"p":
        return np.frombuffer(posting, "<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(posting, np.uint8, offset=1))).astype(np.uint16)


def _segment(keys: list[int], grams: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The postings of a segment's texts, as 16-bit places, and the texts' keys."""
    at = np.repeat(np.arange(len(grams), dtype=np.uint16), [len(g) for g in grams])
    gram = np.concatenate(grams)
    order = np.argsort(gram, kind="stable")
    gram, at = gram[order], at[order]
    first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.empty(0, np.int64)
    offsets = np.append(first, len(at))
    held = np.array(keys, "<i8")
    # a segment's name: its keys tell it from any other
    name = xxhash.xxh3_64_intdigest(held.tobytes()) - (1 << 63)
    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([KEYS], pa.int32()), pa.array([held.tobytes()], pa.binary())], schema=INDEX)
    for a in range(0, len(first), 1 << 16):
        some = first[a : a + (1 << 16)]
        lists = [packed(at[x:y], len(keys)) for x, y in zip(offsets[a : a + len(some)].tolist(), offsets[a + 1 : a + len(some) + 1].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), name), pa.int64()), pa.array(gram[some], pa.int32()), pa.array(lists, pa.binary())], schema=INDEX)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: list[int] = []
    grams: list[np.ndarray] = []
    held = 0
    for _, texts, more in _texts(batches):
        for t, key in zip(texts, more, strict=True):
            if keys and (len(keys) >= SEGMENT or held + len(t) > SEGMENT_BYTES):
                yield from _segment(keys, grams)
                keys, grams, held = [], [], 0
            keys.append(key)
            grams.append(codes_of(t))
            held += len(t)
    if keys:
        yield from _segment(keys, grams)


def index(docs: DataFrame, text: str = "text") -> DataFrame:
    """The postings (segment, gram, places) of ``docs``, written: every later rule reads them."""
    rows = docs.select("doc_id", text).mapInArrow(_indexed, "segment long, gram int, places binary")
    return stored(rows, "trigrams")


def wanted(rules: tuple[Rule, ...]) -> dict[int, object]:
    """Rule number to its query, for the rules that have one."""
    found = {n: trigram_query(r.pattern, r.flags) for n, r in enumerate(rules)}
    return {n: q for n, q in found.items() if q is not None}


def _answer(query, postings: dict[int, np.ndarray]) -> np.ndarray:
    """The places that a query leaves: postings intersected and united."""
    if isinstance(query, str):
        return postings.get(code(query), np.empty(0, np.uint16))
    parts = sorted((_answer(q, postings) for q in query[1]), key=len)
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): the texts whose trigrams satisfy a rule's query, and those rules' numbers as bits."""
    queries = wanted(rules)
    grams = sorted({code(g) for q in queries.values() for g in trigrams_of(q)})

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["segment"]):
            lists = dict(zip(rows.column("gram").to_pylist(), rows.column("places").to_pylist(), strict=True))
            keys = np.frombuffer(lists.pop(KEYS), "<i8")
            held = {g: unpacked(p) for g, p in lists.items()}
            bits = np.zeros(len(keys), np.int64)
            for n, q in queries.items():
                bits[_answer(q, held)] |= 1 << n
            some = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(bits[some])], ["key", "rules"])

    read = postings.where(F.col("gram").isin([KEYS, *grams])).repartition("segment").sortWithinPartitions("segment")
    found = read.mapInArrow(answered, "key long, rules long")
    return found.groupBy("key").agg(F.bit_or("rules").alias("rules"))


SPANS = "array<struct<kind: string, start: long, stop: long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def scanned(text: bytes, rules: tuple[Rule, ...], which: list[int]) -> list[dict]:
    """Spans of the rules of these numbers in a text, by start, then the rules' order."""
    s = text.decode("utf-8", "surrogatepass")
    found = sorted((a, n, b) for n in which for a, b in rules[n].spans(s))
    return [{"kind": rules[n].kind, "start": a, "stop": b} for a, n, b in found]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text", postings: DataFrame | None = None) -> DataFrame:
    """(doc_id, spans: array<struct<kind, start, stop>>) by start, then the rules' order.

    ``postings`` is the index of ``docs``, made here if there is none yet.
    """
    docs = docs.select("doc_id", text)
    postings = index(docs, text) if postings is None else postings
    left = stored(candidates(postings, rules), "candidates")
    passes = id_filter(left.select("key"))
    sought = set(wanted(rules))
    always = [n for n in range(len(rules)) if n not in sought]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, keys in _texts(batches):
            no = np.flatnonzero(~passes(np.array(keys, np.int64)))
            spans = [scanned(texts[k], rules, always) for k in no.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(no)), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, keys in _texts(batches):
            yes = pa.array(passes(np.array(keys, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), batch.column(1)], ["doc_id", "key", "text"]).filter(yes)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, bits = batch.column("text").cast(pa.binary()), batch.column("rules").to_pylist()
            spans = [scanned(t.as_py() or b"", rules, sorted({*always, *(n for n in sought if (b or 0) >> n & 1)})) for t, b in zip(texts, bits, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    kind = f"doc_id {id_type}, spans {SPANS}"
    moved = docs.mapInArrow(keyed, f"doc_id {id_type}, key long, text string").join(left, "key", "left").select("doc_id", "text", "rules")
    return docs.mapInArrow(others, kind).union(moved.mapInArrow(verified, kind))
