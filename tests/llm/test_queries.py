from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from lexiloom.llm import queries as llm
from lexiloom.llm.secrets import MORE
from tests.compare import agrees
from tests.conftest import SMALL
from tests.llm.test_text_operators import cut_brute

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, name):
    agrees(spark, llm.queries()[name], SQL[name])


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def digest(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def test_repeats_query_equals_brute_force(spark):
    want = {(i, n, gone, runs, digest(kept)) for i, n, gone, runs, kept in cut_brute(sorted(documents(spark).items()))}
    rows = llm.queries()["op4_bwt_dedup"](spark, SMALL).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want and len(rows) == len(want)


def test_tokens_query_equals_the_library(spark):
    from tokenizers import Tokenizer

    from lexiloom.llm.q_bpe import tokenizer_path

    its, want = Tokenizer.from_file(tokenizer_path()), {}
    for i, t in documents(spark).items():
        ids = its.encode(t, add_special_tokens=False).ids
        want[i] = len(ids), digest(np.array(ids, "<u4").tobytes()), digest(its.decode(ids, skip_special_tokens=False).encode())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in llm.queries()["op5_bpe"](spark, SMALL).collect()} == want


def test_secrets_query_equals_a_plain_scan(spark):
    """Base kinds by patterns written here; the others by theirs, over every text, without an index."""
    keywords = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile("(" + keywords + ")[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9+/_.=-]+)")
    want = {}
    for i, t in documents(spark).items():
        found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 12]
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        more = [(m.start(), 3 + k, f"{r.kind}:{m.start()}:{m.end()}") for k, r in enumerate(MORE) for m in re.finditer(r.pattern, t)]
        kinds = [sum(f[1] == k for f in found) for k in range(3)]
        want[i] = (*kinds, digest(",".join(f[2] for f in sorted(found)).encode()), ",".join(f[2] for f in sorted(found + more)))
    assert any(w[4] for w in want.values())
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in llm.queries()["op7_secrets"](spark, SMALL).collect()} == want


def test_quality_query_on_rows_held_out(spark):
    import zlib

    rows = {r.doc_id: r for r in llm.queries()["op9_ftrl"](spark, SMALL).collect()}
    assert rows.keys() == documents(spark).keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in rows.items())
    labels = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r.doc_id in rows and r.quality is not None]
    held = [(r.predicted, q) for r, q in labels if r.held_out]
    right, most = sum(p == q for p, q in held), max(sum(q == k for _, q in held) for k in (0, 1))
    assert len(held) >= 5 and right >= most
    ones, zeros = [r.score for r, q in labels if q == 1], [r.score for r, q in labels if q == 0]
    assert sum(a > b for a in ones for b in zeros) > 0.9 * len(ones) * len(zeros)
