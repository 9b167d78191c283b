"""Bloom filters as tables of 4,096-byte bitmaps: build, probe, merge, audit, meta data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytesieve.functions.hashing import seeded_hash, slot, slots_of
from bytesieve.functions.sizing import false_adds, filter_bits, zero_bit_share
from bytesieve.session import lookup_join, materialize

# Bitmaps of 4 KiB that may be broadcast together: 32 MiB.
BROADCAST_BITMAPS = 8_192
# Bits among which a blocked filter spreads the bits of one gram.
BLOCK_BITS = 512
# Size of the one-hash filter that goes before a shuffled join: up to 2**30 bits, 128 MiB.
POSSIBLE_BITS_PER_GRAM = 16
POSSIBLE_MAX_BITS = 1 << 30


def bits_for(capacity: int, k: int) -> int:
    """Bits of a filter of ``capacity`` elements and k hashes."""
    return int(capacity * k / math.log(2))


def blocked_slots(data: Column, k: int, bits: int) -> Column:
    """k bits of the bytes, all within one block of ``BLOCK_BITS``.

    One hash picks the block; the others give seven 9-bit places each.
    """
    blocks = max(1, -(-bits // BLOCK_BITS))
    places = [
        F.shiftrightunsigned(seeded_hash(data, 1 + number // 7), 9 * (number % 7)).bitwiseAND(F.lit(BLOCK_BITS - 1))
        for number in range(k)
    ]
    first = slot(data, 0, blocks) * BLOCK_BITS
    return F.array(*[first + place for place in places])


def _placed(grams: DataFrame, k: int, bits: int, keep: tuple[str, ...], blocked: bool = False) -> DataFrame:
    """k rows per gram: bitmap number and bit inside it."""
    slots = blocked_slots if blocked else slots_of
    at = grams.select(*keep, F.explode(slots(F.col("gram"), k, bits)).alias("_at"))
    return at.select(
        *keep,
        F.bitmap_bucket_number(F.col("_at") + 1).alias("bucket"),
        F.bitmap_bit_position(F.col("_at") + 1).alias("bit"),
    )


def build_bloom(
    vocab: DataFrame, k: int, bits: int, by: tuple[str, ...] = (), *, blocked: bool = False
) -> DataFrame:
    """Bitmaps of the filter that holds all grams of ``vocab``.

    The bits of a gram lie anywhere, or ``blocked`` in one block of 512, so that one lookup answers for a gram
    (``probe_blocked``) at a somewhat higher rate of false positives (``blocked_false_share``).

    Positions are moved to their bitmap before any bitmap is made, so the shuffle carries
    8-byte positions and not one 4 KiB bitmap per task and bucket.
    """
    keys = [*by, "bucket"]
    return (
        _placed(vocab, k, bits, by, blocked)
        .repartition(*keys)
        .groupBy(*keys)
        .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )


def merge_blooms(*filters: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Union of filters of equal size and hashes."""
    merged = filters[0]
    for bitmaps in filters[1:]:
        merged = merged.unionByName(bitmaps)
    return merged.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bits_set(bitmaps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Bits that are 1."""
    return bitmaps.groupBy(*by).agg(F.sum(F.bitmap_count("bitmap")).cast("long").alias("bits_set"))


def _bit_is_set(bitmap: Column, bit: Column) -> Column:
    byte_at = (F.shiftright(bit, 3) + 1).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, byte_at, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (bit % 8).cast("int"))


def _words(bitmap: str) -> Column:
    """The bytes of a bitmap as 512 signed words, so that asking for a bit is plain arithmetic."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(4_089), F.lit(8)),
        lambda at: F.conv(F.hex(F.substring(bitmap, at, F.lit(8))), 16, -10).cast("long"),
    )


def _word_bit(words: Column, bit: Column) -> Column:
    """Bit ``bit`` of a bitmap given as words."""
    shift = (7 - F.shiftright(bit, 3) % 8) * 8 + bit % 8
    return F.getbit(F.element_at(words, (F.shiftright(bit, 6) + 1).cast("int")), shift.cast("int"))


def keep_possible(df: DataFrame, members: DataFrame, column: str = "gram") -> DataFrame:
    """Rows whose ``column`` may be in ``members``; rows surely outside are gone.

    A one-hash filter of ``members`` is broadcast (at most 128 MiB, whatever the number of
    members) and asked in place, so that a join with a large table afterwards shuffles only
    the rows that can match. ``members`` is a stored table with a ``gram`` column.
    """
    bits = min(max(members.count() * POSSIBLE_BITS_PER_GRAM, 1), POSSIBLE_MAX_BITS)
    bitmaps = materialize(build_bloom(members, 1, bits), "possible")
    table = bitmaps.select("bucket", _words("bitmap").alias("_words"))
    at = slots_of(F.col(column), 1, bits)[0]
    placed = df.withColumn("_at", at + 1).withColumn("bucket", F.bitmap_bucket_number("_at"))
    return (
        placed.withColumn("_bit", F.bitmap_bit_position("_at"))
        .join(F.broadcast(table), "bucket")
        .where(_word_bit(F.col("_words"), F.col("_bit")) == 1)
        .select(*df.columns)
    )


def probe_bloom(
    grams: DataFrame, bitmaps: DataFrame, k: int, bits: int, by: tuple[str, ...] = ()
) -> DataFrame:
    """Each distinct gram with ``maybe``: whether the filter (of its group) calls it present."""
    asked = _placed(grams.select(*by, "gram").distinct(), k, bits, (*by, "gram"))
    keys = [*by, "bucket"]
    found = lookup_join(asked, bitmaps.select(*keys, "bitmap"), keys, max_rows=BROADCAST_BITMAPS)
    hit = F.coalesce(_bit_is_set(F.col("bitmap"), F.col("bit")).cast("int"), F.lit(0))
    return found.groupBy(*by, "gram").agg((F.min(hit) == 1).alias("maybe"))


def probe_blocked(
    grams: DataFrame, bitmaps: DataFrame, k: int, bits: int, by: tuple[str, ...] = (), max_rows: int = BROADCAST_BITMAPS
) -> DataFrame:
    """Every row of ``grams`` with ``maybe``: whether the blocked filter (of its group) calls its gram present.

    All bits of a gram lie in one bitmap, so a row stays one row: bitmaps of checked size are broadcast and rows are
    answered where they are; larger filters are joined by bitmap, and nothing is grouped by gram.
    """
    keys = [*by, "bucket"]
    slots = blocked_slots(F.col("gram"), k, bits)
    asked = grams.withColumn("_slots", slots).withColumn("bucket", F.bitmap_bucket_number(F.col("_slots")[0] + 1))
    table = bitmaps.select(*keys, _words("bitmap").alias("_words"))
    found = lookup_join(asked, table, keys, spread_by=F.xxhash64("gram"), max_rows=max_rows)
    hits = F.forall("_slots", lambda at: _word_bit(F.col("_words"), F.bitmap_bit_position(at + 1)) == 1)
    return found.select(*grams.columns, F.coalesce(F.col("_words").isNotNull() & hits, F.lit(False)).alias("maybe"))


def blocked_false_share(bitmaps: DataFrame, k: int, bits: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Expected share of false positives: the mean over blocks of the share of set bits to the power k."""
    blocks = max(1, -(-bits // BLOCK_BITS))
    width = BLOCK_BITS // 8
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(4_096 // width - 1)), lambda i: F.substring("bitmap", i * width + 1, F.lit(width))
    )
    filled = bitmaps.select(*by, F.explode(parts).alias("_block"))
    share = F.pow(F.bitmap_count("_block") / F.lit(float(BLOCK_BITS)), F.lit(float(k)))
    return filled.groupBy(*by).agg((F.sum(share) / blocks).alias("false_share"))


def completed(first: DataFrame, k: int, bits: int) -> DataFrame:
    """Each gram of a filter filled in order of first ``step`` with ``complete``, the step that set the last of its bits.

    A slot is set by the gram with its smallest step, and a refused gram sets none, so a
    gram is refused exactly if all of its slots have a smaller first step than its own.
    """
    by_slot = Window.partitionBy("_slot")
    placed = first.select(
        "gram", "step", F.explode(F.array_distinct(slots_of(F.col("gram"), k, bits))).alias("_slot")
    )
    return (
        placed.withColumn("_set_at", F.min("step").over(by_slot))
        .groupBy("gram", "step")
        .agg(F.max("_set_at").alias("complete"))
    )


def first_colliding(first: DataFrame, k: int, bits: int) -> DataFrame:
    """Grams that a filter filled in order of first ``step`` already calls present."""
    return completed(first, k, bits).where(F.col("complete") < F.col("step")).select("gram", "step")


def audit_bloom(stepped: DataFrame, packets: DataFrame, k: int, bits: int) -> DataFrame:
    """Exact set beside a filter filled in step order, one row of counters.

    ``add_ok`` new and accepted, ``add_no`` new but refused (false positive), ``add_re``
    repeats; ``repeats_called_new`` counts those of grams whose bits were not all set by their first step.
    """
    counted = stepped.groupBy("gram").agg(F.min("step").alias("step"), F.count("*").alias("cnt"))
    bits_of = completed(counted.select("gram", "step"), k, bits).select("gram", "complete")
    unset = F.col("complete") > F.col("step")
    totals = counted.join(bits_of, "gram", "left").agg(
        F.sum("cnt").alias("ngrams"),
        F.count("*").alias("distinct_grams"),
        F.count_if(F.col("complete") < F.col("step")).alias("add_no"),
        F.coalesce(F.sum(F.when(unset, F.col("cnt") - 1)), F.lit(0)).cast("long").alias("repeats_called_new"),
    )
    read = packets.agg(F.count("*").alias("packets")).withColumn("_one", F.lit(1))
    return (
        totals.withColumn("_one", F.lit(1))
        .join(read, "_one")
        .select(
            "packets",
            "ngrams",
            "distinct_grams",
            (F.col("ngrams") - F.col("distinct_grams")).alias("repeats"),
            (F.col("distinct_grams") - F.col("add_no")).alias("add_ok"),
            "add_no",
            (F.col("ngrams") - F.col("distinct_grams")).alias("add_re"),
            "repeats_called_new",
        )
    )


def bloom_meta(
    vocab: DataFrame, capacity: int, k: int, by: tuple[str, ...] = ("tier", "generation")
) -> DataFrame:
    """Size, error rate and fill forecast of the filter of each tier and generation."""
    return (
        vocab.groupBy(*by)
        .agg(F.count("*").alias("n_added"))
        .withColumn("capacity", F.lit(capacity).cast("long"))
        .withColumn("error_rate", F.lit(2.0**-k))
        .withColumn("k", F.lit(k))
        .withColumn("num_bits", filter_bits(F.col("capacity"), F.col("k")))
        .withColumn("zero_share", zero_bit_share(F.col("num_bits"), F.col("n_added"), F.col("k")))
        .withColumn("add_no", false_adds(F.col("num_bits"), F.col("n_added"), F.col("k")))
        .withColumn("add_ok", F.col("n_added") - F.col("add_no"))
    )
