"""Top-k count tables and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_grams(counts: DataFrame, k: int) -> DataFrame:
    """The k grams of largest count; equal counts are taken in gram order."""
    return counts.withColumn("cnt", F.abs("cnt")).orderBy(F.col("cnt").desc(), "gram").limit(k)


def frequent(counts: DataFrame, above: int = 10) -> DataFrame:
    """Rows counted more than ``above`` times."""
    return counts.where(F.col("cnt") > above)


def duplicate_grams(table: DataFrame) -> DataFrame:
    """Grams that occur in more than one row, with their number of rows."""
    return table.groupBy("gram").agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def only_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` whose gram ``right`` does not have; counters kept."""
    return left.join(right.select("gram"), "gram", "left_anti")


def also_right(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` whose gram ``right`` has too; counters kept."""
    return left.join(right.select("gram"), "gram", "left_semi")


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sizes of two gram sets and of their intersection, and its share of the smaller."""
    sides = left.select("gram", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select("gram", F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    merged = sides.groupBy("gram").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return merged.agg(
        F.sum("l").cast("long").alias("left_size"),
        F.sum("r").cast("long").alias("right_size"),
        F.sum(F.col("l") * F.col("r")).cast("long").alias("common"),
    ).withColumn("common_share", F.col("common") / F.least("left_size", "right_size"))


def gram_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct grams of ``left`` that are not in ``right``."""
    return left.select("gram").subtract(right.select("gram"))


def first_names(names: DataFrame, limit: int, column: str = "name") -> DataFrame:
    """The first ``limit`` distinct names in order."""
    return names.select(column).distinct().orderBy(column).limit(limit)
