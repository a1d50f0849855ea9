"""Tables that a job writes for itself in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; a temporary one where none is set and one machine does all."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexiloom-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/lexiloom-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written and read again: lineage is cut and survives lost executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds ``rank``, a row's place (from 1) among those of its key by ``order``.

    Rows are moved once, sorted as a whole and stored in slices; a slice counts what it has of each
    key, so that the rows of one key need not meet in one task.
    """
    rows = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    rows = stored(rows.withColumn("_at", F.monotonically_increasing_id())).withColumn("_slice", F.shiftright("_at", 33))
    slices = rows.groupBy(key, "_slice").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = stored(slices.select(key, "_slice", (F.coalesce(before, F.lit(0)) + 1 - F.col("_low")).alias("_more")))
    return rows.join(slices, [key, "_slice"]).withColumn("rank", (F.col("_at") + F.col("_more")).cast("int")).drop("_at", "_slice", "_more")
