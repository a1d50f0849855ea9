"""op3: documents arrive in four parts, are compacted, and are read by the manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexiloom.llm.common import shared_dir, table
from lexiloom.llm.sharding import Store

ARRIVALS = 4


def op3_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    store = Store(spark, f"{shared_dir(spark)}/lexiloom-store-{uuid.uuid4().hex}")
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(ARRIVALS)) == k))
    version = store.compact()
    store.vacuum()
    return store.read(version).select(
        "doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), F.lit(version).cast("long").alias("version")
    )


QUERIES = {"op3_sharding": op3_sharding}

ORACLE_SQL = {
    "op3_sharding": f"SELECT doc_id, source, strlen(text)::BIGINT AS n_bytes, sha256(text) AS text_sha256, {ARRIVALS + 1}::BIGINT AS version FROM documents"
}
