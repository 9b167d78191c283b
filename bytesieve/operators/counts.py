"""Exact and approximate gram counts, ceilings, merges, statistics, lookups."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from bytesieve.functions.codec import hex_decode, windows
from bytesieve.functions.hashing import sign, slot
from bytesieve.functions.sizing import collision_share
from bytesieve.session import lookup_join

# Windows that a task counts at a time.
PART_WINDOWS = 1 << 22
# Windows of a payload that are looked up at a time.
SLICE_WINDOWS = 1 << 20
# Bytes of a window that fit in one number.
NUMBER_BYTES = 8
# Counters of a dense sketch that are held in one row.
PAGE_CELLS = 4_096


def decoded(payloads: DataFrame, *, inner_space: bool = False) -> DataFrame:
    """Replace ``payload_hex`` by ``payload``; undecodable payloads are dropped."""
    data = hex_decode(F.col("payload_hex"), inner_space=inner_space)
    return payloads.withColumn("payload", data).drop("payload_hex").where(F.col("payload").isNotNull())


def drop_counts(payloads: DataFrame, n: int) -> DataFrame:
    """One row: payloads read, undecodable, shorter than n bytes, kept."""
    data = hex_decode(F.col("payload_hex"))
    return payloads.select(data.alias("payload")).agg(
        F.count("*").alias("payloads"),
        F.count_if(F.col("payload").isNull()).alias("undecodable"),
        F.count_if(F.length("payload") < n).alias("too_short"),
        F.count_if(F.length("payload") >= n).alias("kept"),
    )


def count_grams(
    payloads: DataFrame, n: int, *, by: tuple[str, ...] = (), max_wins: int | None = None
) -> DataFrame:
    """Exact count per gram (and ``by`` columns) over all windows of ``payload``."""
    return windows(payloads, n, keep=by, max_wins=max_wins).groupBy(*by, "gram").agg(
        F.count("*").alias("cnt")
    )


def _window_numbers(data: np.ndarray, n: int) -> np.ndarray:
    """The n-byte windows of ``data`` as big-endian numbers."""
    size = len(data) - n + 1
    numbers = np.zeros(size, np.uint64)
    for at in range(n):
        numbers = (numbers << np.uint64(8)) | data[at : at + size]
    return numbers


def _as_grams(numbers: np.ndarray, n: int) -> pa.Array:
    spelled = np.ascontiguousarray(numbers.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - n :])
    ends = np.arange(len(numbers) + 1, dtype=np.int32) * np.int32(n)
    return pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(ends), pa.py_buffer(spelled)])


def _first_seen(numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ``numbers`` of n bytes, where each stands first, and how often it occurs."""
    spare = 8 * (NUMBER_BYTES - n)
    if len(numbers) > 1 << spare:
        return np.unique(numbers, return_index=True, return_counts=True)
    # Number and place in one word: sorting words is ten times faster than sorting places by their numbers.
    words = np.sort((numbers << np.uint64(spare)) | np.arange(len(numbers), dtype=np.uint64))
    sorted_numbers = words >> np.uint64(spare)
    begins = np.flatnonzero(np.concatenate([[True], sorted_numbers[1:] != sorted_numbers[:-1]]))
    first = (words[begins] & np.uint64((1 << spare) - 1)).astype(np.int64)
    return sorted_numbers[begins], first, np.diff(begins, append=len(words))


def partial_counts(
    payloads: DataFrame,
    n: int,
    *,
    by: tuple[str, ...] = (),
    start: str | None = None,
    max_wins: int | None = None,
    part_windows: int = PART_WINDOWS,
) -> DataFrame:
    """All windows of ``payload``, counted in parts of ``part_windows`` within each task: ``by``, gram, cnt.

    A gram has one row per part that it occurs in, and its counts add up to the exact one (``merge_counts``). Where each
    distinct gram of a part will do, or its number of occurrences, a row per window would cost many times more.
    ``start`` names a column with the number of windows before the payload; ``step``, the number of the gram's first
    window in the part, is given with it.
    """
    if not 1 <= n <= NUMBER_BYTES:
        raise ValueError("a window of 1 to 8 bytes is one number")
    schema = StructType([payloads.schema[name] for name in by]).add("gram", BinaryType()).add("cnt", LongType())
    schema = schema.add("step", LongType()) if start else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[int, np.ndarray]]] = defaultdict(list)
        sizes: dict[tuple, int] = defaultdict(int)

        def counted(key: tuple) -> pa.RecordBatch:
            # In order of their steps, so that the first place of a gram has its first step.
            pieces = sorted(held.pop(key), key=lambda piece: piece[0])
            numbers = np.concatenate([piece for _, piece in pieces])
            del sizes[key]
            if start:
                grams, first, cnt = _first_seen(numbers, n)
                ends = np.cumsum([len(piece) for _, piece in pieces])
                piece = np.searchsorted(ends, first, side="right")
                shifts = np.array([before + len(piece) for before, piece in pieces], np.int64) - ends
                steps = [pa.array(shifts[piece] + first + 1, pa.int64())]
            else:
                (grams, cnt), steps = np.unique(numbers, return_counts=True), []
            same = [pa.repeat(pa.scalar(value, kind), len(grams)) for value, kind in zip(key, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*same, _as_grams(grams, n), pa.array(cnt, pa.int64()), *steps], schema.names)

        for batch in batches:
            kinds = [batch.schema.field(name).type for name in by]
            keys = zip(*[batch.column(name).to_pylist() for name in by], strict=True) if by else [()] * batch.num_rows
            starts = batch.column(start).to_pylist() if start else [0] * batch.num_rows
            for key, before, payload in zip(keys, starts, batch.column("payload"), strict=True):
                data = np.frombuffer(payload.as_buffer() or b"", np.uint8)
                data = data[: max_wins + n - 1] if max_wins else data
                for at in range(0, len(data) - n + 1, part_windows):
                    numbers = _window_numbers(data[at : at + part_windows + n - 1], n)
                    held[key].append((before + at, numbers))
                    sizes[key] += len(numbers)
                    if sizes[key] >= part_windows:
                        yield counted(key)
                if sum(sizes.values()) >= 2 * part_windows:
                    yield from [counted(key) for key in list(held)]
        yield from [counted(key) for key in list(held)]

    return payloads.select(*by, *([start] if start else []), "payload").mapInArrow(run, schema)


def _slots(numbers: np.ndarray, bits: int) -> np.ndarray:
    return (numbers * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def possible_counts(
    payloads: DataFrame, vocab: DataFrame, n: int, id_col: str, *, slice_windows: int = SLICE_WINDOWS
) -> DataFrame:
    """Windows of each payload by what a one-hash filter of ``vocab`` says: ``id_col``, num_wins, gram, cnt.

    A slice of a payload gives one row with its number of windows and without a gram, and one for each distinct gram that
    may be in ``vocab``. The filter lets no gram of ``vocab`` out; others that it lets in are left to the caller's join.
    ``vocab`` must be of checked size (``session.fits``).
    """
    if not 1 <= n <= NUMBER_BYTES:
        raise ValueError("a window of 1 to 8 bytes is one number")
    members = [bytes(row["gram"]) for row in vocab.where(F.length("gram") == n).select("gram").collect()]
    bits = max(16, (16 * len(members)).bit_length())
    table = np.zeros(1 << bits, np.bool_)
    if members:
        spelled = np.frombuffer(b"".join(members), np.uint8).reshape(-1, n)
        table[_slots(np.array([_window_numbers(gram, n)[0] for gram in spelled], np.uint64), bits)] = True
    shared = payloads.sparkSession.sparkContext.broadcast(table)
    schema = StructType([payloads.schema[id_col]]).add("num_wins", LongType()).add("gram", BinaryType()).add("cnt", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        possible = shared.value

        def looked_up(ids: pa.Array, rows: tuple, wins: tuple, grams: tuple, cnt: tuple) -> Iterator[pa.RecordBatch]:
            without = [pa.array(wins, pa.int64()), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64())]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), *without], schema.names)
            of = np.repeat(rows, [len(some) for some in grams])
            held = [pa.nulls(len(of), pa.int64()), _as_grams(np.concatenate(grams), n), pa.array(np.concatenate(cnt), pa.int64())]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *held], schema.names)

        for batch in batches:
            ids, slices, held = batch.column(id_col), [], 0
            for row, payload in enumerate(batch.column("payload")):
                data = np.frombuffer(payload.as_buffer() or b"", np.uint8)
                for at in range(0, len(data) - n + 1, slice_windows):
                    numbers = _window_numbers(data[at : at + slice_windows + n - 1], n)
                    grams, cnt = np.unique(numbers[possible[_slots(numbers, bits)]], return_counts=True)
                    slices.append((row, len(numbers), grams, cnt))
                    held += len(grams)
                    if held >= slice_windows:
                        yield from looked_up(ids, *zip(*slices, strict=True))
                        slices, held = [], 0
            if slices:
                yield from looked_up(ids, *zip(*slices, strict=True))

    return payloads.select(id_col, "payload").mapInArrow(run, schema)


def occurrences(counts: DataFrame) -> DataFrame:
    """Each counted gram as often as it occurs, spelled as hex text."""
    others = [name for name in counts.columns if name not in ("gram", "cnt")]
    every = F.explode(F.sequence(F.lit(1).cast("long"), F.col("cnt")))
    spelled = counts.select(*others, F.lower(F.hex("gram")).alias("gram"), "cnt")
    return spelled.select(*others, "gram", every.alias("_at")).drop("_at")


def _spelled(grams: DataFrame) -> str:
    """Expression of the hex text of ``gram``, which may already be that text."""
    return "lower(hex(gram))" if isinstance(grams.schema["gram"].dataType, BinaryType) else "gram"


def capped(counts: DataFrame, ceiling: int) -> DataFrame:
    """Counts held at ``ceiling``, with the number of adds beyond it."""
    over = F.greatest(F.col("cnt") - ceiling, F.lit(0).cast("long"))
    return counts.withColumn("ceilings", over).withColumn(
        "cnt", F.least(F.col("cnt"), F.lit(ceiling).cast("long"))
    )


def merge_counts(
    *tables: DataFrame, by: tuple[str, ...] = (), ceiling: int | None = None
) -> DataFrame:
    """Sum several count tables per gram, optionally held at a ceiling."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    merged = merged.groupBy(*by, "gram").agg(F.sum("cnt").alias("cnt"))
    return capped(merged, ceiling).drop("ceilings") if ceiling else merged


def lookup_counts(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """Count of each asked gram, 0 where the table has none; ask each gram once."""
    found = lookup_join(grams, counts.select("gram", "cnt"), ["gram"])
    return found.withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("long")))


def count_statistics(counts: DataFrame, slots: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Tries, keys, load factor, mean and spread of the counters, share below the door.

    The door is the mean count, at least 2, below which a counter may be taken over.
    """
    grouped = counts.withColumn("_all", F.lit(1))
    keys = ["_all", *by]
    totals = grouped.groupBy(*keys).agg(
        F.sum("cnt").alias("tries"),
        F.count("*").alias("keys"),
        F.avg("cnt").alias("mean_cnt"),
        F.stddev_pop("cnt").alias("std_cnt"),
    )
    # At most one row per distinct counter value and group.
    levels = grouped.groupBy(*keys, "cnt").agg(F.count("*").alias("_keys"))
    door = F.greatest(F.lit(2).cast("long"), F.expr("tries div (1 + keys)"))
    below = F.sum(F.when(F.col("cnt") < F.col("door"), F.col("_keys")))
    return (
        levels.join(totals, keys)
        .withColumn("door", door)
        .groupBy(*keys, "tries", "keys", "mean_cnt", "std_cnt", "door")
        .agg(F.coalesce(below, F.lit(0).cast("long")).alias("below_door"))
        .withColumn("load_factor", F.col("keys") / F.lit(float(slots)))
        .withColumn("below_share", F.col("below_door") / F.col("keys"))
        .drop("_all")
    )


def heavy_hitters(
    grams: DataFrame, k: int, *, tracked: int = 10_000, by: tuple[str, ...] = ()
) -> DataFrame:
    """The k most frequent grams by a bounded sketch (``heavy_sketch`` gives one that merges).

    ``tracked`` counters are kept per group; counts are exact while no more distinct
    grams than that occur, and otherwise off by at most 3.5 * windows / map size.
    """
    top = F.expr(f"approx_top_k({_spelled(grams)}, {int(k)}, {int(tracked)})")
    return (
        grams.groupBy(*by)
        .agg(top.alias("_top"))
        .select(*by, F.explode("_top").alias("_entry"))
        .select(*by, F.col("_entry.item").alias("gram_hex"), F.col("_entry.count").alias("cnt"))
    )


def heavy_sketch(grams: DataFrame, *, tracked: int = 10_000, by: tuple[str, ...] = ()) -> DataFrame:
    """Frequent-gram sketch of ``tracked`` counters per group, to be stored and merged."""
    return grams.groupBy(*by).agg(F.expr(f"approx_top_k_accumulate({_spelled(grams)}, {int(tracked)})").alias("sketch"))


def merge_heavy(sketches: DataFrame, *, tracked: int = 10_000, by: tuple[str, ...] = ()) -> DataFrame:
    """Sketches of runs, tiers or days combined into one per group; the error bounds of their windows add up."""
    return sketches.groupBy(*by).agg(F.expr(f"approx_top_k_combine(sketch, {int(tracked)})").alias("sketch"))


def heavy_from(sketches: DataFrame, k: int, *, by: tuple[str, ...] = ()) -> DataFrame:
    """The k most frequent grams of each sketch with their estimated counts."""
    top = F.expr(f"approx_top_k_estimate(sketch, {int(k)})")
    return sketches.select(*by, F.explode(top).alias("_entry")).select(
        *by, F.col("_entry.item").alias("gram_hex"), F.col("_entry.count").alias("cnt")
    )


def distinct_sketch(grams: DataFrame, by: tuple[str, ...] = (), lg_k: int = 14) -> DataFrame:
    """Mergeable distinct-count sketch of the grams, one row per group."""
    return grams.groupBy(*by).agg(F.hll_sketch_agg("gram", F.lit(lg_k)).alias("sketch"))


def merge_distinct(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Estimated distinct grams of the union of several sketches."""
    return sketches.groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_grams")
    )


def saturation(estimates: DataFrame, slots: int, k: int) -> DataFrame:
    """Keys a k-choice table of ``slots`` slots would lose, from ``distinct_grams``."""
    share = collision_share(F.col("distinct_grams"), F.lit(slots), k)
    return (
        estimates.withColumn("collide_share", share)
        .withColumn("no_seat", F.floor(F.col("distinct_grams") * F.col("collide_share")).cast("long"))
        .withColumn(
            "load_factor",
            (F.col("distinct_grams") - F.col("no_seat")).cast("double") / F.lit(float(slots)),
        )
    )


def signed_sketch(counts: DataFrame, slots: int, k: int = 5) -> DataFrame:
    """Signed-counter frequency sketch: per seed and slot the sum of signed counts.

    Takes counted grams, so a frequent gram adds one row per seed.
    """
    seeds = [
        F.struct(
            F.lit(number).alias("seed_no"),
            slot(F.col("gram"), number, slots).alias("slot"),
            (sign(F.col("gram"), number) * F.col("cnt")).alias("step"),
        )
        for number in range(k)
    ]
    return (
        counts.select(F.inline(F.array(*seeds)))
        .groupBy("seed_no", "slot")
        .agg(F.sum("step").alias("cell"))
    )


def merge_signed(*sketches: DataFrame) -> DataFrame:
    """Add several signed sketches of equal slots and seeds."""
    merged = sketches[0]
    for sketch in sketches[1:]:
        merged = merged.unionByName(sketch)
    return merged.groupBy("seed_no", "slot").agg(F.sum("cell").alias("cell"))


def estimate_signed(grams: DataFrame, sketch: DataFrame, slots: int, k: int = 5) -> DataFrame:
    """Estimated count of each distinct gram: the median over seeds of sign * cell."""
    seeds = [
        F.struct(
            F.lit(number).alias("seed_no"),
            slot(F.col("gram"), number, slots).alias("slot"),
            sign(F.col("gram"), number).alias("_sign"),
        )
        for number in range(k)
    ]
    asked = grams.select("gram").distinct().select("gram", F.inline(F.array(*seeds)))
    probed = lookup_join(asked, sketch, ["seed_no", "slot"])
    vote = F.coalesce(F.col("_sign") * F.col("cell"), F.lit(0).cast("long"))
    # One vote per seed and gram, so a plain maximum picks it.
    votes = probed.groupBy("gram").agg(
        *[F.max(F.when(F.col("seed_no") == number, vote)).alias(f"_{number}") for number in range(k)]
    )
    ordered = F.array_sort(F.array(*[F.col(f"_{number}") for number in range(k)]))
    middle = (ordered[(k - 1) // 2] + ordered[k // 2]) / F.lit(2.0)
    return votes.select("gram", middle.alias("estimate"))


def dense_sketch(sketch: DataFrame, slots: int, k: int = 5) -> DataFrame:
    """The cells of a signed sketch as rows (seed_no, page, cells) of ``PAGE_CELLS`` counters each, zeros too."""
    spark = sketch.sparkSession
    pages = -(-slots // PAGE_CELLS)
    number = F.col("id")
    empty = spark.range(k * pages * PAGE_CELLS).select(
        (number / (pages * PAGE_CELLS)).cast("int").alias("seed_no"),
        (number % (pages * PAGE_CELLS)).alias("slot"),
        F.lit(0).cast("long").alias("cell"),
    )
    whole = sketch.select("seed_no", F.col("slot").cast("long").alias("slot"), "cell").unionByName(empty)
    cells = whole.groupBy("seed_no", "slot").agg(F.sum("cell").alias("cell"))
    page = F.expr(f"slot div {PAGE_CELLS}").cast("int")
    return (
        cells.groupBy("seed_no", page.alias("page"))
        .agg(F.sort_array(F.collect_list(F.struct("slot", "cell"))).alias("_cells"))
        .select("seed_no", "page", F.col("_cells.cell").alias("cells"))
    )


def estimate_dense(grams: DataFrame, pages: DataFrame, slots: int, k: int = 5) -> DataFrame:
    """Every row of ``grams`` with ``estimate``, its count by a stored ``dense_sketch``: the median over seeds.

    One lookup per seed in a table of pages, broadcast if its measured bytes allow; a row stays where it is and one row.
    """
    found = grams
    for number in range(k):
        place = slot(F.col("gram"), number, slots)
        of_seed = pages.where(F.col("seed_no") == number).select("page", F.col("cells").alias(f"_cells_{number}"))
        found = found.withColumn("page", F.floor(place / PAGE_CELLS).cast("int"))
        found = lookup_join(found, of_seed, ["page"], spread_by=F.xxhash64("gram"))
        cell = F.element_at(f"_cells_{number}", (place % PAGE_CELLS + 1).cast("int"))
        found = found.withColumn(f"_vote_{number}", sign(F.col("gram"), number) * cell).drop("page", f"_cells_{number}")
    ordered = F.array_sort(F.array(*[F.col(f"_vote_{number}") for number in range(k)]))
    middle = (ordered[(k - 1) // 2] + ordered[k // 2]) / F.lit(2.0)
    return found.select(*grams.columns, middle.alias("estimate"))


def gram_hex(column: Column | str = "gram") -> Column:
    """Grams leave as lower-case hex text."""
    return F.lower(F.hex(column)).alias("gram_hex")
