"""Run-once folder ingest: gram counts, second sightings and live counters per batch.

Every job reads the files that are new since its last run (``availableNow``) and stops. The
checkpoint remembers the files taken; each batch is written under its own number, so a
replayed batch replaces itself and nothing is added twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bytesieve.functions.codec import num_windows, windows
from bytesieve.operators.counts import count_grams, decoded, merge_counts
from bytesieve.sources.tables import latest_version, load_table, save_table

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose stream state lives in RocksDB files."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        value = spark.conf.get(key, None)
        if value is not None:
            session.conf.set(key, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return session


def payload_stream(
    spark: SparkSession,
    folder: str,
    *,
    files_per_batch: int | None = None,
    archive: str | None = None,
) -> DataFrame:
    """New ``*.txt`` files of hex lines as a stream of ``payload_hex`` and ``file``.

    With ``archive`` a file moves there once a later batch has been planned.
    """
    reader = spark.readStream.format("text").option("pathGlobFilter", "*.txt")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder).select(
        F.col("value").alias("payload_hex"), F.col("_metadata.file_name").alias("file")
    )


def run_batches(
    stream: DataFrame,
    checkpoint: str,
    write: Callable[[DataFrame, int], None],
    *,
    mode: str = "append",
) -> StreamingQuery:
    """Process all new input with ``write(batch, batch_id)`` and wait for the end."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return query


def _write_delta(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def read_deltas(spark: SparkSession, path: str, schema: str = "gram binary, cnt long") -> DataFrame:
    """Rows of all batches with their ``batch_id``."""
    return spark.read.schema(f"{schema}, batch_id long").option("basePath", path).parquet(path)


def ingest_counts(
    spark: SparkSession,
    folder: str,
    deltas: str,
    checkpoint: str,
    n: int = 5,
    *,
    max_wins: int | None = None,
    files_per_batch: int | None = None,
    archive: str | None = None,
) -> StreamingQuery:
    """Count the grams of new files, one delta table per batch."""
    stream = payload_stream(spark, folder, files_per_batch=files_per_batch, archive=archive)
    write_delta = _write_delta(deltas)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_delta(count_grams(decoded(batch), n, max_wins=max_wins), batch_id)

    return run_batches(stream, checkpoint, write)


def compact_counts(spark: SparkSession, deltas: str, table: str) -> DataFrame:
    """Add the batches not yet merged to the saved count table and return it."""
    new = read_deltas(spark, deltas)
    if latest_version(spark, table) is not None:
        old = load_table(spark, table)
        merged_through = old.agg(F.max("through")).first()[0]
        new = new.where(F.col("batch_id") > (-1 if merged_through is None else merged_through))
        total = merge_counts(old.select("gram", "cnt"), new.select("gram", "cnt"))
    else:
        total = merge_counts(new.select("gram", "cnt"))
    through = read_deltas(spark, deltas).agg(F.max("batch_id")).first()[0]
    save_table(total.withColumn("through", F.lit(through).cast("long")), table)
    return load_table(spark, table).select("gram", "cnt")


def ingest_second_sightings(
    spark: SparkSession,
    folder: str,
    deltas: str,
    checkpoint: str,
    n: int = 5,
    *,
    max_wins: int | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Keep running gram counts as stream state; write grams once they are seen twice."""
    session = state_session(spark)
    grams = windows(
        decoded(payload_stream(session, folder, files_per_batch=files_per_batch)), n, max_wins=max_wins
    )
    running = grams.groupBy("gram").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= 2)
    return run_batches(running, checkpoint, _write_delta(deltas), mode="update")


def second_sighting_vocabulary(spark: SparkSession, deltas: str) -> DataFrame:
    """Grams seen twice or more in all batches so far, with their latest count."""
    return read_deltas(spark, deltas).groupBy("gram").agg(F.max("cnt").alias("cnt"))


def observe_training(payloads: DataFrame, n: int, name: str = "train") -> DataFrame:
    """Attach live counters: payload lines, undecodable, too short, windows.

    They arrive with each batch in the query's progress under ``observedMetrics``.
    """
    wins = num_windows(F.col("payload"), n)
    return payloads.observe(
        name,
        F.count(F.lit(1)).alias("payloads"),
        F.count_if(F.col("payload").isNull()).alias("undecodable"),
        F.count_if(F.length("payload") < n).alias("too_short"),
        F.coalesce(F.sum(wins), F.lit(0)).cast("long").alias("ngrams"),
    )


def count_training(
    payloads: DataFrame, n: int, path: str, checkpoint: str
) -> StreamingQuery:
    """Keep the counters of ``observe_training`` for every batch of a stream, one row each under ``path``.

    A replayed batch replaces its row, and no batch is forgotten however many there are.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        wins = num_windows(F.col("payload"), n)
        row = batch.agg(
            F.count(F.lit(1)).alias("payloads"),
            F.count_if(F.col("payload").isNull()).alias("undecodable"),
            F.count_if(F.length("payload") < n).alias("too_short"),
            F.coalesce(F.sum(wins), F.lit(0)).cast("long").alias("ngrams"),
        )
        row.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return run_batches(payloads, checkpoint, write)


def training_counters(spark: SparkSession, path: str) -> DataFrame:
    """Counters of all batches with their ``batch_id``."""
    return read_deltas(spark, path, "payloads long, undecodable long, too_short long, ngrams long")


def observed_totals(query: StreamingQuery, name: str = "train") -> list[dict]:
    """Counters of each batch in the query's recent progress that read anything, with its ``batch_id``.

    Spark keeps a limited number of progress reports; for totals use ``count_training``.
    """
    return [
        {"batch_id": progress["batchId"], **progress["observedMetrics"][name].asDict()}
        for progress in query.recentProgress
        if name in progress["observedMetrics"] and progress["numInputRows"] > 0
    ]
