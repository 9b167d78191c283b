"""Payload inputs: hex lines, raw byte lines, CSV columns, run-once file lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Reading order of a line: file, then split, then position inside the split.
LINE_ORDER = ["file", "block_start", "row_id"]


def _ordered(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
        "value",
    )


def hex_lines(spark: SparkSession, path: str | list[str], tier: str | None = None) -> DataFrame:
    """Hex payload lines of text files, with their reading order."""
    lines = _ordered(spark.read.text(path))
    return lines.select(*LINE_ORDER, F.lit(tier).alias("tier"), F.col("value").alias("payload_hex"))


def raw_lines(spark: SparkSession, path: str | list[str], *, keep_end: bool = False) -> DataFrame:
    """Bytes of each line of any file; ``keep_end`` puts the line feed back.

    A last line that ends without a line feed gets one too with ``keep_end``.
    """
    lines = _ordered(spark.read.option("lineSep", "\n").text(path))
    data = F.col("value").cast("binary")
    if keep_end:
        data = F.concat(data, F.lit(b"\n"))
    return lines.select(*LINE_ORDER, data.alias("payload"))


def csv_payloads(spark: SparkSession, path: str, column: str = "payload") -> DataFrame:
    """Hex payloads from one column of CSV files with a header."""
    return spark.read.csv(path, header=True).select(F.col(column).alias("payload_hex"))


def file_names(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Paths of the files in a folder; file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select(F.col("path").alias("name"))
    )


def unused_files(names: DataFrame, used: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` names in order that earlier runs have not taken."""
    return names.join(used.select("name"), "name", "left_anti").orderBy("name").limit(limit)
