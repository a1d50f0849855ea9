"""BPE with word ends: encoding by a queue of merge ranks, decoding by vocabulary strings.

A word's symbols form a doubly linked list.  A priority queue holds the mergeable
neighbours by (rank, place); popping one merges it, links its new neighbours and pushes
the two new pairs, while entries whose symbols have changed meanwhile are skipped as
stale.  A word of n symbols takes O(n log n), however long it is.

Text is treated as the tokenizer file prescribes: special tokens are cut out of the raw
text, the rest is put in NFC and lower case (a letter at a time, so no final sigma), white
space parts words, and UTF-8 bytes are written as the byte-level letters.

The file is read on the driver; vocabulary and merges, whose size the file fixes, are
broadcast.  Chunks between white space and their words are encoded once and kept, up to a bound.

Letters, numbers and cases are those of the interpreter's Unicode tables (15.1 in Python
3.13) with what the library's newer tables add; its table of canonical forms is older, and
what that one lacks is left as it stands.  Both differences are fixed values below.

Defined results: null text is empty and has no tokens; decoding joins the tokens' strings
by blanks, as a tokenizer without decoder does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiloom.llm.common import slices

#: White space to the tokenizer; ``str.split`` also cuts at U+001C to U+001F.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed values of the tokenizer's format: contractions, the end-of-word mark.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_END = "</w>"
#: Letters and numbers of Unicode 16, in which the library splits words.
NEWER_LETTERS = """1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B
    1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"""
NEWER_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: Capitals of Unicode 16 and 17, and the small letter of the first of each range.
NEWER_CAPITALS = "1C89:1C8A A7CB:264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:19B 10D50-10D65:10D70 16EA0-16EB8:16EBB"
#: Marks, and one letter with its mark, that the library's canonical forms do not
#: know: they are neither moved nor composed.
UNKNOWN_MARKS = """7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF
    10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 11938 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42
    11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"""
CACHED = 300_000
CACHED_CHARS = 64


def byte_letters() -> list[str]:
    """The letter of every byte: itself where it is printable in Latin-1, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def spans(text: str) -> list[tuple[int, int]]:
    """First and last code point of each range of ``A-B C ...``."""
    ends = [[int(x, 16) for x in r.split("-")] for r in text.split()]
    return [(e[0], e[-1]) for e in ends]


def _class(found: list[tuple[int, int]]) -> str:
    """The body of a character class."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


def _ranges(kind: str) -> list[tuple[int, int]]:
    """All code points of a general category, L or N, in the interpreter's tables."""
    out, last = [], -2
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == kind:
            if c != last + 1:
                out.append([c, c])
            out[-1][1] = last = c
    return [(a, b) for a, b in out]


def word_pattern() -> re.Pattern:
    """Contractions, runs of letters, single numbers, runs of other signs."""
    letters, numbers = _class(_ranges("L") + spans(NEWER_LETTERS)), _class(_ranges("N") + spans(NEWER_NUMBERS))
    return re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")


_UNKNOWN = re.compile(f"([{_class(spans(UNKNOWN_MARKS))}]+)")
_SMALL = {ord("Σ"): "σ"}
for _pair in NEWER_CAPITALS.split():
    _from, _to = _pair.split(":")
    (_first, _last), = spans(_from)
    _SMALL |= {c: chr(int(_to, 16) + c - _first) for c in range(_first, _last + 1)}


def normal_form(text: str) -> str:
    """NFC and lower case, a letter at a time, by the library's tables."""
    if text.isascii():
        return text.lower()
    if _UNKNOWN.search(text):
        parts = _UNKNOWN.split(text)
        parts[::2] = [unicodedata.normalize("NFC", p) for p in parts[::2]]
        text = "".join(parts)
    else:
        text = unicodedata.normalize("NFC", text)
    return text.translate(_SMALL).lower()


class WordBpe:
    """A tokenizer from (vocabulary, merges, special tokens)."""

    def __init__(self, spec: dict):
        self.ids: dict[str, int] = spec["vocab"]
        self.special: dict[str, int] = spec["special"]
        self.strings = [""] * (max([*self.ids.values(), *self.special.values()], default=-1) + 1)
        for s, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = s
        #: The rank of a pair of ids, as one number; the id that the pair of a rank becomes.
        self.ranks = {self.ids[a] << 32 | self.ids[b]: rank for rank, (a, b) in enumerate(spec["merges"])}
        self.merged = [self.ids[a + b] for a, b in spec["merges"]]
        self.ends = {c: self.ids[c + WORD_END] for c in byte_letters() if c + WORD_END in self.ids}
        self.letters = byte_letters()
        self.split = word_pattern()
        self.separators = re.compile(r"[\x1c-\x1f]")
        self.solid = re.compile(f"[^{SPACE}]+")
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.chunks, self.words = _Kept(self.encode_chunk), _Kept(self.encode_form)

    @staticmethod
    def spec(path: str) -> dict:
        """What of a tokenizer file is needed."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        return {"vocab": file["model"]["vocab"], "merges": merges, "special": {t["content"]: t["id"] for t in file["added_tokens"]}}

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word, a string of byte letters without its end mark."""
        if not word:
            return []
        ids, rank_of, merged = self.ids, self.ranks.get, self.merged
        symbol = [ids[c] for c in word]
        symbol[-1] = self.ends[word[-1]]
        n = len(symbol)
        # an entry is rank * n + place; it is stale unless its place still begins a pair of its rank
        queue = [r * n + i for i in range(n - 1) if (r := rank_of(symbol[i] << 32 | symbol[i + 1])) is not None]
        if not queue:
            return symbol
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            rank, i = divmod(pop(queue), n)
            j = after[i]
            if j < 0 or symbol[i] < 0 or rank_of(symbol[i] << 32 | symbol[j]) != rank:
                continue
            symbol[i] = new = merged[rank]
            symbol[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of(new << 32 | symbol[k])) is not None:
                    push(queue, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank_of(symbol[h] << 32 | new)) is not None:
                push(queue, r * n + h)
        return [s for s in symbol if s >= 0]

    def encode_chunk(self, chunk: str) -> bytes:
        """The packed ids of a text without special tokens or white space.

        A chunk of several words, or in another form than the file wants, is put together
        from those of its words, whose form is not made again: lower case may undo it.
        """
        form = normal_form(chunk)
        # the pattern's most frequent cases: letters alone, letters and one sign
        if form.isalpha():
            words = [form]
        elif form[-1] in ".,;:!?" and form[:-1].isalpha():
            words = [form[:-1], form[-1]]
        else:
            words = self.split.findall(form)
        if words != [chunk]:
            return b"".join(map(self.words.__getitem__, words))
        return self.encode_form(chunk)

    def encode_form(self, word: str) -> bytes:
        """The packed ids of one word in its form."""
        letters = word if word.isascii() and word.isalpha() else "".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass")))
        return _packed(self.encode_word(letters))

    def encode_packed(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or not self.cut.search(text):
            return self._packed_part(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out.append(self._packed_part(text[at : m.start()]))
            out.append(_packed([self.special[m[0]]]))
            at = m.end()
        return b"".join([*out, self._packed_part(text[at:])])

    def _packed_part(self, text: str) -> bytes:
        chunks = self.solid.findall(text) if self.separators.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """The vocabulary strings of the ids; special tokens are kept."""
        return " ".join(map(self.strings.__getitem__, ids))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Kept(dict):
    """What was made for a string, in two generations: when the younger is full it becomes
    the elder, and what is asked for again moves to the younger."""

    def __init__(self, make):
        self.make, self.elder = make, {}

    def __missing__(self, key: str):
        made = self.elder.get(key)
        if made is None:
            made = self.make(key)
            if len(key) > CACHED_CHARS:
                return made
        if len(self) >= CACHED:
            self.elder = dict(self)
            self.clear()
        self[key] = made
        return made


#: The tokenizer that a worker process holds for its tasks, with what it keeps: some 100 MB.
_held: dict[str, WordBpe] = {}


def _tokenizer(spark, path: str):
    """A function that gives workers the tokenizer of a file that the driver reads."""
    spec = WordBpe.spec(path)
    digest = hashlib.sha256(json.dumps(spec).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(spec)

    def held() -> WordBpe:
        if digest not in _held:
            _held.clear()
            _held[digest] = WordBpe(shared.value)
        return _held[digest]

    return held


def encode_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row: encoded, then decoded."""
    tokenizer = _tokenizer(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer()
        for batch in slices(batches):
            n, ids, decoded = [], [], []
            for t in batch.column(1):
                packed = bpe.encode_packed(t.as_py())
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back = bpe.decode(np.frombuffer(packed, "<u4").tolist())
                decoded.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``: array<int>, empty for null text."""
    tokenizer, docs = _tokenizer(docs.sparkSession, path), docs.drop("ids")
    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    names = [*docs.columns, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer()
        for batch in slices(batches):
            ids = [np.frombuffer(bpe.encode_packed(t.as_py()), "<u4").astype(np.int32) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names)

    return docs.mapInArrow(run, f"{made}, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``decoded``, the string of ``ids``; null ids decode to an empty string."""
    tokenizer, rows = _tokenizer(rows.sparkSession, path), rows.drop("decoded")
    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = [*rows.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer()
        for batch in slices(batches):
            back = [bpe.decode(i.as_py() or ()) for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], names)

    return rows.mapInArrow(run, f"{made}, decoded string")
