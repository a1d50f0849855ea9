"""What the operators of this folder share: word rules, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import ship

#: A word is a run of anything but these; ``bytes.split()`` cuts at the same ones.
BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS + "+"), "")


#: Bytes of an Arrow batch: some texts are long, and a task holds a batch several times.
BATCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> None:
    """Lets workers import this package, and bounds the batches that they get by bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) is a temporary one set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    kept = spark.sparkContext.getCheckpointDir()
    if not kept:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexiloom-"))
        kept = spark.sparkContext.getCheckpointDir()
    return kept.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts lineage."""
    spark = df.sparkSession
    ready(spark)
    path = f"{shared_dir(spark)}/lexiloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a Python worker turns into objects at a time.
SLICE = 256


def slices(batches: Iterator[pa.RecordBatch], n: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of ``n`` rows, so that a worker holds few texts as objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)
    pa.default_memory_pool().release_unused()
