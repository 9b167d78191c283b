"""Helpers shared by the operators: folds, bounded Arrow slices, words, linked groups.

Every Python task here works on slices of a few megabytes of text, so its memory does not grow
with the partition; a single longer document is one slice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytesieve.session import materialize

# Bytes of text that a Python task handles at once.
SLICE_BYTES = 8 << 20


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 5; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each part holds about ``size`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def byte_parts(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets into them."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def word_hashes(words: pa.Array, short: int = 24) -> np.ndarray:
    """64-bit hash of each whole word, the same in every task.

    Words of up to ``short`` bytes are hashed byte by byte, all at once; longer ones one by one, so that a word of
    megabytes takes time in proportion to its bytes only.
    """
    data, offsets = byte_parts(words)
    sizes, starts = np.diff(offsets), offsets[:-1]
    hashed = np.full(len(sizes), 0xCBF29CE484222325, dtype=np.uint64)
    long = np.flatnonzero(sizes > short)
    sizes = np.where(sizes > short, 0, sizes)
    for i in range(int(sizes.max(initial=0))):
        more = np.flatnonzero(sizes > i)
        hashed[more] = (hashed[more] ^ data[starts[more] + i]) * np.uint64(0x100000001B3)
    hashed ^= hashed >> np.uint64(29)
    if len(long):
        texts = np.array(words.take(pa.array(long)).to_pylist(), dtype=object)
        hashed[long] = pd.util.hash_array(texts, categorize=False)
    return hashed


class Words:
    """Lower-cased (A-Z) words of texts, split at ASCII white space, as codes of a dictionary.

    ``codes[offsets[i]:offsets[i + 1]]`` are the words of text ``i``; ``vocabulary`` holds each
    different word once. A null or blank text has no words.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        flat = lists.flatten()
        kept = np.concatenate([[0], np.cumsum(pc.not_equal(flat, "").to_numpy(zero_copy_only=False))])
        self.offsets = kept[lists.offsets.to_numpy()]
        coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.vocabulary: pa.Array = coded.dictionary
        self.rows = np.repeat(np.arange(len(lists)), np.diff(self.offsets))


def spanning_forest(size: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each member of a linked group to the group's smallest position; at most size - 1."""
    label = np.arange(size)
    while True:
        lower = label.copy()
        np.minimum.at(lower, left, label[right])
        np.minimum.at(lower, right, label[left])
        np.minimum.at(lower, label, lower)
        lower = lower[lower]
        if np.array_equal(lower, label):
            break
        label = lower
    members = np.flatnonzero(label != np.arange(size))
    return members, label[members]


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b: long); component is the smallest node reachable.

    Each round lets a node point to its lowest neighbour, if lower than itself, and contracts the
    links along the pointers. Even rounds order nodes by number, which settles stars at once; odd rounds
    by a hash of their own, so that a long chain shrinks by a constant share. Links and pointers
    are stored tables, a node with many links is combined before the shuffle, and nothing is collected.
    Links from a node to itself and null ends are ignored; no links give no rows.
    """

    def ordered(frame: DataFrame) -> DataFrame:
        return (
            frame.where(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )

    links = materialize(ordered(edges.select("a", "b")), f"{label}-links")
    pointers: list[DataFrame] = []
    while not links.isEmpty():
        turn = len(pointers)

        def rank(name: str, turn: int = turn) -> Column:
            return F.col(name).cast("long") if turn % 2 == 0 else F.xxhash64(F.col(name), F.lit(turn))

        ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = ends.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(rank("b").alias("r"), "b")).alias("low"))
        to = F.when(F.col("low.r") < rank("node"), F.col("low.b")).otherwise(F.col("node"))
        step = materialize(lowest.select("node", to.alias("to")), f"{label}-step")
        pointers.append(step)
        links = materialize(
            ordered(
                links.join(step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a")
                .join(step.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
                .select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
            ),
            f"{label}-links",
        )
    if not pointers:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = pointers[0]
    for step in pointers[1:]:
        further = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        found = found.join(further, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
    found = materialize(found, f"{label}-roots")
    lowest = found.groupBy("to").agg(F.min("node").alias("component"))
    return found.join(lowest, "to").select("node", F.least("node", "component").alias("component"))
