"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns
the columns of ``documents``, the last one with its tokens.  ``run`` writes each stage's
rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import bpe, line_dedup, minhash, mixing, quality_rules
from lexiloom.llm.common import ready, stored, table
from lexiloom.llm.q_bpe import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SEED = 7


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 of the quality rules rejects go."""
    rows = quality_rules.ledger(docs.select(COLUMNS))
    return quality_rules.apply_policy(rows, quality_rules.POLICIES["v1"]).where("kept").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents go; ``n_chars`` follows the text."""
    ready(spark)
    left = line_dedup.line_dedup(docs.select(COLUMNS), min_docs=10)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    ready(spark)
    return minhash.deduplicated(docs.select(COLUMNS), percent=85)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of documents: each source's words are those that the mix takes of it, to half a document."""
    return mixing.copies(mixing.mix(docs.select(COLUMNS), SEED), COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the ids and their number, and the string that they decode to."""
    ready(spark)
    rows = bpe.decode(bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_path()).drop("text"), tokenizer_path())
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality rules", rules),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokens),
]

#: Byte-pair encoding has no SQL form; the tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
