"""Session helpers: shared scratch storage, scan spreading, size-checked joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

# Rows a lookup side may have before it is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 500_000
# Bytes it may have, as measured from its values.
BROADCAST_BYTES = 128 << 20
# Copies of a lookup side in a shuffled join, so that one hot key is cut in this many parts.
SALTS = 32

_fallback_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder of its own.
    """
    global _fallback_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if _fallback_root is None:
        _fallback_root = tempfile.mkdtemp(prefix="bytesieve-")
        atexit.register(shutil.rmtree, _fallback_root, ignore_errors=True)
    return _fallback_root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_root(spark)}/bytesieve/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Cuts lineage, survives lost executors, fixes values that a recompute could change
    (partition numbers, generated ids) and gives the planner true file sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan of few splits one task per core; leave larger scans as they are.

    Windows multiply rows a thousandfold, so a small file read as one split would run
    on one core. A large input already has more splits than cores and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def fence(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Select ``columns``, each evaluated once per row.

    A filter on a projected column is otherwise pushed below the projection with the whole
    expression copied into it, and nested header or message parsing is copied many times.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def _row_bytes(column: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in a broadcast table."""
    if isinstance(kind, (StringType, BinaryType)):
        return 16 + F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(kind, StructType):
        return reduce(Column.__add__, [_row_bytes(column[field.name], field.dataType) for field in kind.fields])
    if isinstance(kind, ArrayType):
        inner = F.transform(column, lambda value: _row_bytes(value, kind.elementType))
        return 24 + F.coalesce(F.aggregate(inner, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))
    if isinstance(kind, MapType):
        return 16 + F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)).cast("long")
    return F.lit(8).cast("long")


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes; reads no more than one row beyond."""
    size = reduce(Column.__add__, [_row_bytes(F.col(field.name), field.dataType) for field in df.schema.fields])
    found = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).first()
    return found["rows"] <= max_rows and (found["bytes"] or 0) <= max_bytes


def broadcast_bytes_join(left: DataFrame, right: DataFrame, column: str, how: str) -> DataFrame:
    """Broadcast join on one binary column, by its 64-bit hash.

    A broadcast table with one long key is asked several times faster than one with a
    binary key. Equal hashes of different bytes are told apart by comparing the bytes; the
    two comparisons stand for equality, which would be taken as a second join key.
    """
    others = [name for name in right.columns if name != column]
    asked = left.withColumn("_left_hash", F.xxhash64(column))
    table = right.select(
        F.xxhash64(column).alias("_right_hash"), F.col(column).alias("_member"), *others
    )
    same = (
        (F.col("_left_hash") == F.col("_right_hash"))
        & (F.col(column) >= F.col("_member"))
        & (F.col(column) <= F.col("_member"))
    )
    return asked.join(F.broadcast(table), same, how).drop("_left_hash", "_right_hash", "_member")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    *,
    spread_by: Column | None = None,
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``left`` with ``right``, whose ``on`` columns are unique.

    A right side of checked size, in rows and in bytes, is broadcast. A larger one is shuffled; with
    ``spread_by`` it is repeated once per salt and the left rows of one key are dealt
    over the salts, so a key holding a third of all rows is cut in ``salts`` parts.
    ``right`` should be a stored table: the check reads it once more.
    """
    if fits(right, max_rows):
        if len(on) == 1 and isinstance(right.schema[on[0]].dataType, BinaryType):
            return broadcast_bytes_join(left, right, on[0], how)
        return left.join(F.broadcast(right), on, how)
    if spread_by is None:
        return left.join(right, on, how)
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")
