"""op9: a quality score for every document, learnt from the rows that are not held out."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.llm.common import table
from lexiloom.llm.ftrl import score, train

THRESHOLD = 0.3


def op9_ftrl(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a null id has no remainder and is not held out
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_ftrl": op9_ftrl}
