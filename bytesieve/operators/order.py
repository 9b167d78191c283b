"""Ranks and running totals over a whole table without a one-task window.

Rows are range-partitioned by the order key and sorted inside their partition, and the
(partition, position) pair of each row is written to shared storage: range bounds are
sampled, so a recompute could place rows elsewhere. Only one row per partition then
needs a window of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytesieve.functions.codec import SLICE, num_windows, slices, windows
from bytesieve.functions.sizing import unseen_rate
from bytesieve.operators.counts import NUMBER_BYTES, partial_counts
from bytesieve.session import materialize

# monotonically_increasing_id() keeps the partition number above this many position bits.
_POSITION_BITS = 33


def _ranged(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    ranged = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    return (
        materialize(ranged, label)
        .withColumn("_part", F.shiftright("_place", _POSITION_BITS))
        .withColumn("_pos", F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_place")
    )


def global_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """1-based rank by ``order``, whose values must be unique."""
    ranged = _ranged(df, order, "rank")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    # One row per range partition, however large the table is.
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_before")
    )


def running_total(
    df: DataFrame,
    values: dict[str, str],
    order: list[str],
    within: tuple[str, ...] = (),
) -> DataFrame:
    """Sum of each value column over the rows before the current one.

    ``values`` maps value columns to output columns. Totals follow ``order`` (unique
    inside a group) and restart per ``within`` group; a group may span any number of
    partitions. Keep the table narrow: it is written and shuffled once.
    """
    ranged = _ranged(df, [*within, *order], "running")
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    local = (
        Window.partitionBy("_part", *within)
        .orderBy("_pos")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = ranged.groupBy("_part", *within).agg(
        *[F.sum(value).alias(f"_sum_{value}") for value in values]
    )
    bases = sums.select(
        "_part",
        *within,
        *[
            F.coalesce(F.sum(f"_sum_{value}").over(before), F.lit(0)).alias(f"_base_{value}")
            for value in values
        ],
    )
    inside = ranged.select(
        "*",
        *[
            F.coalesce(F.sum(value).over(local), F.lit(0)).alias(f"_local_{value}")
            for value in values
        ],
    )
    joined = inside.join(bases, ["_part", *within])
    return joined.select(
        *df.columns,
        *[
            (F.col(f"_base_{value}") + F.col(f"_local_{value}")).alias(out)
            for value, out in values.items()
        ],
    )


def _with_start(
    payloads: DataFrame, n: int, order: list[str], max_wins: int | None
) -> DataFrame:
    """Payloads of at least one window with ``_start``, the windows of all payloads before."""
    counts = payloads.select(
        *order, num_windows(F.col("payload"), n, max_wins).cast("long").alias("_wins")
    ).where(F.col("_wins") > 0)
    return payloads.join(running_total(counts, {"_wins": "_start"}, order).drop("_wins"), order)


def stepped_windows(
    payloads: DataFrame,
    n: int,
    order: list[str],
    *,
    keep: tuple[str, ...] = (),
    max_wins: int | None = None,
) -> DataFrame:
    """Windows of all payloads numbered 1, 2, ... through the whole table (``step``)."""
    placed = _with_start(payloads, n, order, max_wins)
    return windows(placed, n, keep=(*keep, "_start"), max_wins=max_wins).select(
        *keep, (F.col("_start") + F.col("i") + 1).alias("step"), "gram"
    )


def counted_steps(
    payloads: DataFrame, n: int, order: list[str], *, max_wins: int | None = None
) -> DataFrame:
    """Number of windows and first step of each gram, both from one pass: ``gram``, ``cnt``, ``step``.

    Windows of up to 8 bytes are counted in parts within the tasks; none becomes a row by itself.
    """
    placed = _with_start(payloads, n, order, max_wins)
    if n <= NUMBER_BYTES:
        parts = partial_counts(placed, n, start="_start", max_wins=max_wins)
    else:
        parts = windows(placed, n, keep=("_start",), max_wins=max_wins).select(
            "gram", F.lit(1).cast("long").alias("cnt"), (F.col("_start") + F.col("i") + 1).alias("step")
        )
    return parts.groupBy("gram").agg(F.sum("cnt").alias("cnt"), F.min("step").alias("step"))


def sighting_steps(
    payloads: DataFrame,
    n: int,
    order: list[str],
    *,
    max_wins: int | None = None,
    slice_bytes: int = SLICE,
) -> DataFrame:
    """Step of the first and of the second sighting of each gram: ``sighting``, ``step``.

    First sightings are minima. They go back to their payloads as offsets to leave out, and the
    minima of the remaining windows are the second sightings, so that both passes combine in
    the map tasks and no window is sorted or shuffled by itself.
    """
    placed = _with_start(payloads, n, order, max_wins).select("_start", "payload")
    step = F.col("_start") + F.col("i") + 1
    first = materialize(
        windows(placed, n, keep=("_start",), max_wins=max_wins)
        .select("gram", "_start", step.alias("step"))
        .groupBy("gram")
        .agg(F.min("step").alias("step"), F.min_by("_start", "step").alias("_start"))
        .select("_start", "step"),
        "first-sightings",
    )
    offset = (F.col("step") - F.col("_start") - 1).cast("int")
    seen = (
        first.select("_start", offset.alias("_offset"))
        .select("_start", (F.col("_offset") % slice_bytes).alias("_at"), (F.col("_offset") - F.col("_offset") % slice_bytes).alias("_from"))
        .groupBy("_start", "_from")
        .agg(F.collect_list("_at").alias("_seen"))
    )
    parts = slices(placed, n, keep=("_start",), max_wins=max_wins, slice_bytes=slice_bytes)
    every = F.sequence(F.lit(0), F.col("_count") - 1)
    rest = parts.join(seen, ["_start", "_from"], "left").select(
        "_start",
        "_from",
        "_slice",
        F.explode(F.when(F.col("_seen").isNull(), every).otherwise(F.array_except(every, "_seen"))).alias("_at"),
    )
    second = (
        rest.select(
            F.substring("_slice", F.col("_at") + 1, F.lit(n)).alias("gram"),
            (F.col("_start") + F.col("_from") + F.col("_at") + 1).alias("step"),
        )
        .groupBy("gram")
        .agg(F.min("step").alias("step"))
    )
    return first.select(F.lit(1).alias("sighting"), "step").unionByName(
        second.select(F.lit(2).alias("sighting"), "step")
    )


def training_curve(
    payloads: DataFrame,
    n: int,
    order: list[str],
    *,
    every: int = 10_000,
    max_wins: int | None = None,
) -> DataFrame:
    """Totals after each ``every`` windows: first and second sightings, unseen share.

    ``add_tmp_ok`` counts grams seen once or more so far, ``add_ok`` those seen twice or
    more, ``unseen_rate`` the percentage of possible grams beyond both. Only full intervals
    give a row, as the log is written at multiples.
    """
    spark = payloads.sparkSession
    sightings = sighting_steps(payloads, n, order, max_wins=max_wins)
    added = sightings.groupBy(F.floor((F.col("step") - 1) / every).alias("bucket")).agg(
        F.count_if(F.col("sighting") == 1).alias("_tmp"),
        F.count_if(F.col("sighting") == 2).alias("_ok"),
    )
    wins = num_windows(F.col("payload"), n, max_wins).cast("long")
    total = payloads.agg(F.coalesce(F.sum(wins), F.lit(0)).alias("total")).first()["total"]
    buckets = spark.range(total // every).withColumnRenamed("id", "bucket")
    filled = buckets.join(added, "bucket", "left").fillna(0, ["_tmp", "_ok"])
    sums = running_total(filled, {"_tmp": "_tmp_before", "_ok": "_ok_before"}, ["bucket"])
    curve = sums.select(
        ((F.col("bucket") + 1) * every).alias("ngrams"),
        (F.col("_ok_before") + F.col("_ok")).alias("add_ok"),
        (F.col("_tmp_before") + F.col("_tmp")).alias("add_tmp_ok"),
    )
    return curve.withColumn("unseen_rate", unseen_rate(n, F.col("add_ok"), F.col("add_tmp_ok")))


def saturation_step(keyed: DataFrame, key: str, order: str, threshold: int) -> DataFrame:
    """Number of rows read when the distinct count of ``key`` first passes ``threshold``.

    One row with ``step``; no row if the threshold is never passed.
    """
    first = keyed.groupBy(key).agg(F.min(order).alias("_first"))
    passed = global_rank(first.select("_first"), ["_first"]).where(F.col("rank") == threshold + 1)
    stop = passed.first()
    read = keyed.where(F.col(order) <= stop["_first"]) if stop else keyed.where(F.lit(False))
    return read.agg(F.count("*").alias("step")).where(F.col("step") > 0)


def within_budget(
    lines: DataFrame, n: int, budget: int, order: list[str], min_bytes: int | None = None
) -> DataFrame:
    """Lines read until the line that pushes the window total past ``budget``.

    That line is still kept. Lines shorter than ``min_bytes`` are never read; a budget of
    0 or less keeps all others.
    """
    long_enough = lines.where(F.length("payload") >= (min_bytes or n))
    if budget <= 0:
        return long_enough
    counts = long_enough.select(*order, num_windows(F.col("payload"), n).cast("long").alias("_wins"))
    kept = running_total(counts, {"_wins": "_before"}, order).where(F.col("_before") <= budget)
    return long_enough.join(kept.select(*order), order, "left_semi")
