"""Substring positions and multi-pattern passage search over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytesieve.functions.codec import windows
from bytesieve.operators.bloom import keep_possible
from bytesieve.session import BROADCAST_ROWS, lookup_join, materialize

# Bytes of a pattern that must match before the whole pattern is hashed.
PREFIX_BYTES = 16
# Pattern bytes that may be broadcast.
BROADCAST_BYTES = 256 << 20


def position(needle: Column, haystack: Column) -> Column:
    """0-based byte position of the first match, -1 if none or if the needle is empty."""
    # One Latin-1 character per byte, so character positions are byte positions.
    find, text = F.decode(needle, "ISO-8859-1"), F.decode(haystack, "ISO-8859-1")
    return F.when(F.length(needle) == 0, F.lit(-1)).otherwise(F.position(find, text) - 1)


def find_passages(
    documents: DataFrame,
    patterns: DataFrame,
    *,
    doc_id: str = "doc_id",
    pattern_id: str = "item_id",
    prefix_bytes: int = PREFIX_BYTES,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Which documents contain which patterns: ids and first 0-based byte position.

    Both sides carry binary ``payload``. Every byte position is hashed over a short prefix
    and joined with the prefixes of the patterns; where one fits, the text is hashed once per
    pattern length known for that prefix and joined on (length, hash), and bytes are
    compared last. Patterns that share a prefix therefore cost one hash per length, not one
    comparison per pattern.
    """
    needles = patterns.where(F.length("payload") > 0).select(
        F.col(pattern_id),
        F.col("payload").alias("_needle"),
        F.length("payload").alias("_len"),
        F.least(F.length("payload"), F.lit(prefix_bytes)).alias("_width"),
        F.xxhash64("payload").alias("_full"),
    )
    prefix_lengths = (
        needles.select(
            "_width",
            F.expr("xxhash64(substring(_needle, 1, _width))").alias("_prefix"),
            "_len",
        )
        .groupBy("_width", "_prefix")
        .agg(F.collect_set("_len").alias("_lens"))
    )
    # At most ``prefix_bytes`` widths: one, unless patterns are shorter than the prefix.
    widths = sorted(row["_width"] for row in needles.select("_width").distinct().collect())
    size = needles.agg(F.count("*").alias("rows"), F.sum("_len").alias("bytes")).first()
    small = size["rows"] <= max_rows and (size["bytes"] or 0) <= BROADCAST_BYTES
    sources = documents.select(doc_id, "payload")
    if not widths:
        return (
            sources.join(needles, F.lit(False))
            .select(doc_id, pattern_id, F.lit(0).cast("long").alias("position"))
        )

    found = None
    for width in widths:
        prefixes = prefix_lengths.where(F.col("_width") == width).select("_prefix", "_lens")
        if small:
            hit = (
                windows(sources.withColumn("_text", F.col("payload")), width, keep=(doc_id, "_text"))
                .withColumn("_prefix", F.xxhash64("gram"))
                .join(F.broadcast(prefixes), "_prefix")
            )
        else:
            # Too many prefixes to broadcast: a filter drops the positions where none can
            # start, the others travel without the text and fetch it after the match.
            starts = materialize(
                needles.where(F.col("_width") == width)
                .select(F.expr("substring(_needle, 1, _width)").alias("gram"))
                .distinct(),
                "prefixes",
            )
            places = keep_possible(windows(sources, width, keep=(doc_id,)), starts).select(
                doc_id, "i", F.xxhash64("gram").alias("_prefix")
            )
            places = lookup_join(
                places, prefixes, ["_prefix"], "inner", spread_by=F.xxhash64(doc_id, "i"), max_rows=max_rows
            )
            hit = places.join(sources.withColumnRenamed("payload", "_text"), doc_id)
        part = hit.select(doc_id, "_text", "i", F.explode("_lens").alias("_len"))
        found = part if found is None else found.unionByName(part)

    candidates = found.select(
        doc_id,
        F.col("i").alias("position"),
        "_len",
        F.substring("_text", (F.col("i") + 1).cast("int"), F.col("_len")).alias("_part"),
    ).withColumn("_full", F.xxhash64("_part"))
    right = F.broadcast(needles) if small else needles
    return (
        candidates.join(right, ["_len", "_full"])
        .where(F.col("_part") == F.col("_needle"))
        .groupBy(doc_id, pattern_id)
        .agg(F.min("position").alias("position"))
    )
