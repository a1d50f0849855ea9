"""Biological sequences, reads and pattern files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions.strings import normalised_bases, value_of


def fasta(spark: SparkSession, path: str, allowed: str = "ACGT", mask: str = "N", separator: str = "\x7f", to_upper: bool = True) -> DataFrame:
    """(seq_id, name, start, length, text) of multi-FASTA files, in order of file name and record.

    ``start`` is where a body would begin in the concatenation with one separator before each.
    Text before a file's first header is skipped, carriage returns are dropped, symbols that
    are not allowed become the mask.  The separator must be larger than all of them.
    """
    if separator <= max([*allowed, mask]):
        raise ValueError("the separator must be larger than every symbol")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    return fasta_records(files, allowed, mask, to_upper)


def fasta_records(files: DataFrame, allowed: str = "ACGT", mask: str = "N", to_upper: bool = True) -> DataFrame:
    """``fasta`` of rows (file, value: the whole file)."""
    # a header begins a line; what comes before the first is no record
    records = F.slice(F.split(F.concat(F.lit("\n"), F.col("value")), "\n>"), 2, 1 << 30)
    rows = files.select("file", F.posexplode(records).alias("k", "record"))
    header = F.substring_index("record", "\n", 1)
    body = F.when(F.instr("record", "\n") > 0, F.expr("substring(record, instr(record, '\n') + 1)")).otherwise("")
    text = normalised_bases(F.translate(body, "\n", ""), allowed, mask, to_upper)
    rows = rows.select("file", "k", F.regexp_extract(header, r"^([^ \t\r]*)", 1).alias("name"), text.alias("text"))
    rows = rows.withColumn("length", F.char_length("text").cast("long"))
    order = Window.orderBy("file", "k")
    start = F.coalesce(F.sum(F.col("length") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    return rows.select((F.row_number().over(order) - 1).cast("long").alias("seq_id"), "name", start.cast("long").alias("start"), "length", "text")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(pat_id, name, pattern, quality) of four-line records; reading stops at a malformed one."""
    return fastq_records(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def fastq_records(files: DataFrame) -> DataFrame:
    lines = F.split(F.translate("value", "\r", ""), "\n")
    rows = files.select("file", F.posexplode(lines).alias("at", "line")).withColumn("k", F.floor(F.col("at") / 4))
    pick = lambda r: F.max(F.when(F.col("at") % 4 == r, F.col("line")))
    records = rows.groupBy("file", "k").agg(pick(0).alias("h"), pick(1).alias("pattern"), pick(2).alias("plus"), pick(3).alias("quality"))
    valid = F.coalesce(F.col("h").startswith("@") & F.col("plus").startswith("+") & F.col("quality").isNotNull(), F.lit(False))
    order = Window.partitionBy("file").orderBy("k")
    records = records.withColumn("_bad", F.sum(F.when(valid, 0).otherwise(1)).over(order)).where("_bad = 0")
    pat_id = (F.row_number().over(Window.orderBy("file", "k")) - 1).cast("long")
    return records.select(pat_id.alias("pat_id"), F.regexp_extract("h", r"^@(\S*)", 1).alias("name"), "pattern", "quality")


def pattern_file(spark: SparkSession, path: str) -> DataFrame:
    """(pat_id, pattern) of files with a header ``# number=N length=L ...`` and N * L characters."""
    files = spark.read.format("binaryFile").load(path).select(F.decode("content", "ISO-8859-1").alias("value"))
    header = F.substring_index("value", "\n", 1)
    n, m = value_of(header, "number").cast("int"), value_of(header, "length").cast("int")
    rows = files.select(n.alias("n"), m.alias("m"), F.expr("substring(value, instr(value, '\n') + 1)").alias("body"))
    pieces = F.expr("transform(sequence(0, n - 1), i -> substring(body, i * m + 1, m))")
    return rows.where("n > 0").select(F.posexplode(pieces).alias("pat_id", "pattern")).select(F.col("pat_id").cast("long"), "pattern")


def reads_to_patterns(reads: DataFrame) -> DataFrame:
    return reads.select("pat_id", "pattern")
