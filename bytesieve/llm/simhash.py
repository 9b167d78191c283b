"""SimHash near duplicates by bit-sliced comparison.

Fingerprints are compared in tiles. A tile stores the 64 bit planes of its fingerprints vertically, 64 fingerprints to
a word; a carry-save counter adds plane after plane of differing bits to all distances at once, and a word is
abandoned as soon as all its distances exceed the radius. Tiles are made of fingerprints that agree in half of
their bits: two fingerprints within the radius differ in at most ``radius`` of ``radius + 2`` bands, so they agree in
two bands at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.llm.common import components, slices, spanning_forest, text_or_empty
from bytesieve.session import materialize

SHINGLE_WORDS = 3
RADIUS = 2
HASH_SEED = 42
BITS = 64
# Fingerprints that a tile holds, about; a larger group of agreeing ones is compared tile by tile.
TILE = 2048


def fingerprint(words: list[bytes], size: int = SHINGLE_WORDS) -> int:
    """SimHash of lower-cased words: bit set in over half of the shingles' XXH64 values, repeats included."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxh64_intdigest(joined, HASH_SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    cuts = zip(starts[: 1 - size].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
    return _majority(np.array([xxh64_intdigest(joined[a:b], HASH_SEED) for a, b in cuts], dtype="<u8"))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        block = hashes[start : start + (1 << 14)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(object) << np.arange(BITS).astype(object)).sum())


def text_fingerprints(texts: pa.Array, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprint of each whole text."""
    lists = [raw.translate(_LOWER).split() for raw in texts.cast(pa.binary()).to_pylist()]
    return np.array([fingerprint(words, size) for words in lists], dtype=np.uint64)


# A-Z in lower case; bytes.split() parts at the ASCII white space 0x09-0x0D and 0x20.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def with_fingerprints(documents: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every document; fp holds the 64 bits as a long. Null texts count as empty: fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = text_fingerprints(part.column(1), size).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "fp"])

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    return chosen.mapInArrow(run, "doc_id long, fp long")


class Planes:
    """Bit planes of fingerprints: ``planes[b, w]`` holds bit b of fingerprints 64 w to 64 w + 63."""

    def __init__(self, fingerprints: np.ndarray):
        self.size = len(fingerprints)
        self.words = -(-self.size // 64)
        padded = np.zeros(self.words * 64, dtype="<u8")
        padded[: self.size] = fingerprints
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, fingerprint) positions at most ``radius`` bits apart."""
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        query, word = np.divmod(np.arange(len(queries) * self.words), max(1, self.words))
        counter = [np.zeros(len(query), np.uint64) for _ in range(radius.bit_length())]
        over = np.zeros(len(query), np.uint64)
        for b in range(BITS):
            flip = np.where((queries[query] >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))
            carry = self.planes[b][word] ^ flip
            for digit in range(len(counter)):
                counter[digit], carry = counter[digit] ^ carry, counter[digit] & carry
            over |= carry | _exceeds(counter, radius)
            if b % 8 == 7:
                # Words whose 64 distances all exceed the radius are abandoned.
                alive = np.flatnonzero(over != full)
                if len(alive) < len(query):
                    query, word, over = query[alive], word[alive], over[alive]
                    counter = [digit[alive] for digit in counter]
        inside = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, lane = np.nonzero(inside)
        found = word[at] * 64 + lane
        real = found < self.size
        return query[at][real], found[real]


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Mask of the lanes whose count is above ``radius``, digit by digit from the highest."""
    above, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for digit in reversed(range(len(counter))):
        if not radius >> digit & 1:
            above |= equal & counter[digit]
            equal &= ~counter[digit]
        else:
            equal &= counter[digit]
    return above


def close_pairs(fingerprints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (left < right) of fingerprints at most ``radius`` bits apart."""
    planes = Planes(fingerprints)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 18) // max(1, planes.words))
    for start in range(0, len(fingerprints), step):
        a, b = planes.within(fingerprints[start : start + step], radius)
        keep = a + start < b
        left.append(a[keep] + start)
        right.append(b[keep])
    return np.concatenate(left), np.concatenate(right)


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) of ids whose fingerprints are at most ``radius`` bits apart: a spanning forest per tile.

    ``distinct`` is a stored table (id, fp) with every fingerprint once. Rows meet under each pair of bands. Small groups
    of agreeing fingerprints share tiles; a larger one is cut into parts by hash and every two parts
    form a tile, so no tile grows with the input and no pair is lost.
    """
    edges = np.linspace(0, BITS, radius + 3).astype(int)
    bands = [((1 << int(b)) - (1 << int(a))) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [a | b for a, b in combinations(bands, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select(
        "id", "fp",
        F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed))).alias("band", "key"),
    )
    groups = materialize(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-groups")
    tiles = max(1, (groups.agg(F.sum("n")).first()[0] or 0) // tile)
    parts = F.ceil(F.col("n") / tile)
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = (
        keyed.join(groups, ["band", "key"])
        .withColumn("parts", parts)
        .withColumn("part", part)
        .withColumn("other", other)
        .select(
            "id", "fp",
            F.when(F.col("parts") == 1, F.pmod(F.xxhash64("band", "key"), F.lit(tiles)))
            .otherwise(F.xxhash64("band", "key")).alias("tile"),
            F.when(F.col("parts") == 1, F.lit(-1)).otherwise(F.least("part", "other")).cast("long").alias("i"),
            F.when(F.col("parts") == 1, F.lit(-1)).otherwise(F.greatest("part", "other")).cast("long").alias("j"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        ids, first = np.unique(table["id"].to_numpy(), return_index=True)
        left, right = close_pairs(table["fp"].to_numpy()[first].view(np.uint64), radius)
        a, b = spanning_forest(len(ids), left, right)
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return dealt.groupBy("tile", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, size: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every document.

    component_id is the smallest doc_id reachable through fingerprints at most ``radius`` bits apart, the document
    itself included. Equal fingerprints are one node, so copies make no pairs. Texts without words (null ones
    too) have fingerprint 0 and link like any other. Repeated rows give repeated results; rows
    without doc_id are fingerprinted but link nothing and have no component. An empty table gives no rows.
    """
    prints = materialize(with_fingerprints(documents, size), "simhash")
    known = prints.where("doc_id IS NOT NULL")
    distinct = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-distinct")
    linked = components(link_fingerprints(distinct, radius), "simhash")
    roots = (
        distinct.join(linked.withColumnRenamed("node", "id"), "id", "left")
        .select("fp", F.coalesce("component", "id").alias("component_id"))
    )
    without = prints.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long"))
    return known.join(materialize(roots, "simhash-roots"), "fp").select("doc_id", "fp", "component_id").union(without)


def keep_first(documents: DataFrame, size: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, with all columns.

    Of several rows with that id one stays, the least by a hash of all its columns. Rows without id stay.
    """
    kept_id = "_kept_id"
    while kept_id in documents.columns:
        kept_id = f"_{kept_id}"
    found = near_duplicates(documents, size, radius).where("doc_id IS NOT NULL")
    kept = materialize(
        found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_copies")), "simhash-kept"
    )
    # Hashed at every size: the ids grow with the input, and texts need not be sorted.
    ids = kept.select(F.col("doc_id").alias(kept_id)).hint("shuffle_hash")
    stay = documents.join(ids, F.col("doc_id") == F.col(kept_id), "left_semi")
    if not kept.where("_copies > 1").isEmpty():
        # Columns of any type can be hashed as JSON, also those that have no order.
        whole = F.struct(*documents.columns)
        first = F.min_by(whole, F.sha2(F.to_json(whole), 256))
        stay = stay.groupBy("doc_id").agg(first.alias("_row")).select("_row.*").select(*documents.columns)
    return stay.unionByName(documents.where("doc_id IS NULL"))
