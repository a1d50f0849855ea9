"""op7: the secrets of every document, as counts and digests of their spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.llm.common import table
from lexiloom.llm.secrets import BASE, find_secrets


def op7_secrets(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op7_secrets": op7_secrets}
