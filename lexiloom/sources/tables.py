"""Texts and symbol sequences as DataFrames: Parquet, plain files, event streams of a table.

A text collection is (doc_id, text); a pattern set is (pat_id, pattern).  One row is one
sequence, so no match can cross from one to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(rows: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """(doc_id, text); null texts are empty."""
    return rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name, text) of plain files, numbered by name."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("text"))
    return files.select((F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("doc_id"), "name", "text")


def byte_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name, text) with one character, U+0000 to U+00FF, for every byte of a file."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), F.decode("content", "ISO-8859-1").alias("text"))
    return files.select((F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("doc_id"), "name", "text")


def sequences(rows: DataFrame, key: str, symbol: str, order: list[str]) -> DataFrame:
    """(doc_id, symbols: array<int>) of a table's rows, in order within a key, and its alphabet.

    Symbols are ranks in the order of ``symbol``, as ``alphabet`` gives them.
    """
    ranked = rows.join(F.broadcast(alphabet(rows, symbol)), symbol)
    pairs = F.struct(*order, "rank")
    return ranked.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.transform(F.sort_array(F.collect_list(pairs)), lambda p: p["rank"]).alias("symbols"))


def alphabet(rows: DataFrame, symbol: str) -> DataFrame:
    """(symbol, rank): order-preserving and dense, from 1; unknown symbols have no row."""
    distinct = rows.select(symbol).where(F.col(symbol).isNotNull()).distinct()
    return distinct.select(symbol, F.dense_rank().over(Window.orderBy(symbol)).cast("int").alias("rank"))


def save_index(tables: dict[str, DataFrame], path: str) -> None:
    """Writes the tables of an index, each partition sorted by document."""
    for name, table in tables.items():
        table.sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load_index(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}
