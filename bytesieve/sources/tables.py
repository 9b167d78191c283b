"""Saved count tables and filters as versioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("version long").parquet(f"{path}/_versions_log")
    except AnalysisException:
        return None


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Newest published version of a saved table, None if there is none."""
    log = _versions(spark, path)
    return None if log is None else log.agg(F.max("version")).first()[0]


def save_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """Write a new version and publish it; readers keep the old one until then.

    The table may be computed from its own earlier version.
    """
    spark = df.sparkSession
    version = (latest_version(spark, path) or 0) + 1
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/version-{version}")
    _publish(spark, path, version)
    return version


def _publish(spark: SparkSession, path: str, version: int) -> None:
    spark.range(1).select(F.lit(version).cast("long").alias("version")).coalesce(1).write.mode(
        "append"
    ).parquet(f"{path}/_versions_log")


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest published version of a saved table."""
    version = latest_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no published table in {path}")
    return spark.read.parquet(f"{path}/version-{version}")


def save_counts(counts: DataFrame, path: str) -> int:
    """Save ``gram_counts(tier, gram, cnt)``."""
    return save_table(counts, path, ("tier",))


def load_counts(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, path).select("tier", "gram", "cnt")


_BITMAPS = "bucket long, bitmap binary, tier string, generation int"


def save_filters(bitmaps: DataFrame, meta: DataFrame, path: str) -> int:
    """Save filter generations and one meta row each, with the bits their bitmaps hold, as one version.

    Bitmaps are computed once: what they hold is read from the files. Both tables are written before the version is
    published, so a reader sees either the whole version or the one before.
    """
    spark = bitmaps.sparkSession
    keys = ["tier", "generation"]
    version = (latest_version(spark, path) or 0) + 1
    folder = f"{path}/version-{version}"
    bitmaps.write.mode("overwrite").partitionBy(*keys).parquet(f"{folder}/bitmaps")
    written = spark.read.schema(_BITMAPS).parquet(f"{folder}/bitmaps")
    stored = written.groupBy(*keys).agg(
        F.count("*").alias("buckets"), F.sum(F.bitmap_count("bitmap")).cast("long").alias("bits_set")
    )
    filled = meta.join(stored, keys, "left").fillna(0, ["buckets", "bits_set"])
    filled.write.mode("overwrite").parquet(f"{folder}/meta")
    _publish(spark, path, version)
    return version


def load_filters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bitmaps and meta rows of the readable generations, and the generations skipped.

    A generation is readable if its bitmaps hold what its meta row says; corrupt or missing
    files only take out their own generation.
    """
    keys = ["tier", "generation"]
    version = latest_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no published filters in {path}")
    folder = f"{path}/version-{version}"
    bitmaps = (
        spark.read.option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .schema(_BITMAPS)
        .parquet(f"{folder}/bitmaps")
    )
    meta = spark.read.parquet(f"{folder}/meta")
    found = bitmaps.groupBy(*keys).agg(
        F.count("*").alias("_buckets"), F.sum(F.bitmap_count("bitmap")).cast("long").alias("_bits")
    )
    checked = meta.join(found, keys, "left").withColumn(
        "_readable",
        (F.coalesce("_buckets", F.lit(0)) == F.col("buckets"))
        & (F.coalesce("_bits", F.lit(0)) == F.col("bits_set")),
    )
    good = checked.where("_readable").drop("_buckets", "_bits", "_readable")
    skipped = checked.where(~F.col("_readable")).select(*keys)
    # Generations are few: one row per closed filter.
    readable = bitmaps.join(good.select(*keys), keys, "left_semi")
    return readable, good, skipped
