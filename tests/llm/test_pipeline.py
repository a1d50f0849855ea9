from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lexiloom.llm import queries as llm
from lexiloom.llm.q_bpe import tokenizer_path
from tests.conftest import SMALL
from tests.llm import data
from tests.llm.test_table_operators import by_duckdb
from tests.llm.test_text_operators import components, deduped, measures


def brute(some):
    """(doc_id, source, ids) of the pipeline in plain Python, and the words that the SQL of the mix takes."""
    import re
    from collections import Counter

    from tokenizers import Tokenizer

    rows = []
    for r in some:
        n, chars, symbols, dup, rep = measures(r[1])
        lines = [x for x in (r[1] or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        caps, exclaims = len(re.findall(r"\b[A-Z]{2,}\b", r[1] or "")), (r[1] or "").count("!")
        if n >= 50 and 2 * rep <= n and 10 * symbols <= n and 2 * dup <= len(lines) and 10 * caps <= 3 * n and 10 * exclaims <= 3 * n and 2 * n <= chars <= 15 * n:
            rows.append(r)
    texts = dict((i, t) for i, t, *_ in deduped([(r[0], r[1]) for r in rows], 10))
    rows = [(r[0], texts[r[0]], r[2], r[3]) for r in rows]
    keep = {i for i, _, _, kept in components([(r[0], r[1]) for r in rows], 85) if kept}
    rows = [r for r in rows if r[0] in keep]
    its, out, text = Tokenizer.from_file(tokenizer_path()), Counter(), {r[0]: r[1] for r in rows}
    taken = by_duckdb(rows)
    for doc_id, source, n in whole_copies([(r[0], r[1], r[2], r[5]) for r in taken]):
        out[doc_id, source, tuple(its.encode(text[doc_id], add_special_tokens=False).ids)] += n
    return +out, taken


def whole_copies(rows):
    """(doc_id, source, copies): of all ways to copy a source's documents so many times over and then
    those at the start of its line once more, the one whose words are nearest to what is taken."""
    import hashlib

    for source in {r[1] for r in rows}:
        line = sorted((r for r in rows if r[1] == source), key=lambda r: hashlib.md5(f"{corpus_pipeline.SEED}:{r[0]}".encode()).hexdigest())
        passes, rest = divmod(sum(r[3] for r in line), max(sum(r[2] for r in line), 1))
        ends = [sum(r[2] for r in line[:n]) for n in range(len(line) + 1)]
        first = min(range(len(ends)), key=lambda n: (abs(ends[n] - rest), -n))
        yield from ((r[0], r[1], (passes + (n < first)) * (r[2] > 0)) for n, r in enumerate(line))


def words_of(text):
    return len((text or "").encode().split())


def test_pipeline_equals_brute_force(spark, tmp_path):
    pytest.importorskip("tokenizers")
    from collections import Counter

    shared = [(1000 + i, f"{data.words(__import__('random').Random(i), 70, 9000)}\ncommon footer line", "en", "abc"[i % 3], 1) for i in range(15)]
    some = [r for r in data.rows(n=80) if r[0] is not None] + shared
    some = list({r[0]: r for r in some}.values())
    data.frame(spark, some).withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want, taken = brute(some)
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in rows) == want
    assert all(r.n_tokens == len(r.ids) and bool(r.decoded) == bool(r.ids) for r in rows)
    # and by sums alone: a source's copied words are those taken of it, to half a document
    size = {r[0]: r[2] for r in taken}
    for source in {r[1] for r in taken}:
        copied = sum(size[r.doc_id] for r in rows if r.source == source)
        assert abs(copied - sum(r[5] for r in taken if r[1] == source)) <= max(r[2] for r in taken if r[1] == source) / 2


def test_mixed_words_of_every_source_meet_its_target(spark):
    """The mix stage over the smallest tables: sums of words, whatever the way copies are chosen."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before, copies = {}, {}
    for r in docs.select("doc_id", "source", "text").collect():
        before.setdefault(r.source, []).append(words_of(r.text))
    for r in corpus_pipeline.mix(spark, docs, SMALL).select("doc_id", "source", "text").collect():
        copies.setdefault(r.source, []).append((r.doc_id, words_of(r.text)))
    left, weight, share = dict(before), {s: k % 3 + 1 for k, s in enumerate(sorted(before, key=lambda s: (s is None, s or "")))}, {}
    total = sum(map(sum, before.values()))
    while left:  # sources that reach three times their size stop there, the rest share on
        level = (total - sum(share.values())) / sum(weight[s] for s in left)
        full = [s for s in left if 3 * sum(before[s]) < weight[s] * level]
        share |= {s: 3 * sum(before[s]) for s in full} if full else {s: weight[s] * level for s in left}
        left = {s: v for s, v in left.items() if s not in share}
    for s, sizes in before.items():
        assert abs(sum(n for _, n in copies.get(s, [])) - share[s]) <= max(sizes) / 2 + 0.01 * share[s] + 1
        assert max((sum(i == d for d, _ in copies[s]) for i in {d for d, _ in copies.get(s, [])}), default=0) <= 3


def test_repeated_rows_and_null_ids_pass_the_pipeline(spark, tmp_path):
    data.frame(spark, data.rows(n=60)).withColumn("size", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    docs = data.empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
        assert docs.dtypes == data.empty(spark).dtypes
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_every_operator_has_one_query():
    names = [n for n in llm.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
