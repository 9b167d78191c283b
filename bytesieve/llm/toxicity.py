"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positive class; all other texts are unlabelled, toxic ones among them. The risk of a
classifier on the unseen negative class is the unlabelled risk less the prior's share of the positives' risk; where
an estimate from finite data falls below zero, the step goes back instead of fitting it further down.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.llm.common import Words, fold, slices, text_or_empty, word_hashes

# Confirmed toxic and unlabelled texts that are learned from, at most; chosen by a hash of the id.
SAMPLE_ROWS = 12_000
# Words are hashed to this many columns; those that tell the samples apart are kept, at most KEPT_COLUMNS.
HASH_BITS = 20
KEPT_COLUMNS = 200
THRESHOLD = 0.5


def word_columns(words: pa.Array) -> np.ndarray:
    """Hash of each word's letters (a-z and all beyond ASCII); -1 for a word without any.

    Signs and digits count as nothing, so ``word``, ``word,`` and ``*word*`` are one column.
    """
    letters = pc.replace_substring_regex(words, r"[^a-z\x{80}-\x{10FFFF}]+", "")
    columns = (word_hashes(letters) & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)
    columns[pc.equal(letters, "").to_numpy(zero_copy_only=False)] = -1
    return columns


def present(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of every different hashed word of each text."""
    words = Words(texts)
    column = word_columns(words.vocabulary)[words.codes]
    seen = np.unique((words.rows.astype(np.int64) << HASH_BITS | column)[column >= 0])
    return seen >> HASH_BITS, seen & ((1 << HASH_BITS) - 1)


@dataclass
class Detector:
    """Weights of the kept columns."""

    place: np.ndarray  # hashed column -> kept column, -1 for the others
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        row, column = present(texts)
        kept = self.place[column]
        row, kept = row[kept >= 0], kept[kept >= 0]
        total = self.bias + np.bincount(row, self.weights[kept], len(texts))
        return 1 / (1 + np.exp(-total))


def _select(row: np.ndarray, column: np.ndarray, positive: np.ndarray, kept: int) -> np.ndarray:
    """Columns that are more frequent among positives than among the others, the surest first."""
    in_p = positive[row]
    size = 1 << HASH_BITS
    p, u = np.bincount(column[in_p], minlength=size), np.bincount(column[~in_p], minlength=size)
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    rate = (p + u) / (n_p + n_u)
    # Standard scores of the difference in document frequency.
    z = (p / n_p - u / n_u) / np.sqrt(rate * (1 - rate) * (1 / n_p + 1 / n_u) + 1e-12)
    z[p < max(3, 0.004 * n_p)] = 0
    best = np.argsort(-z, kind="stable")[:kept]
    return np.sort(best[z[best] > 4.0])


def fit(
    row: np.ndarray, column: np.ndarray, positive: np.ndarray, prior: float, *,
    kept: int = KEPT_COLUMNS, steps: int = 1500, rate: float = 0.05, decay: float = 2e-5,
) -> Detector:
    """Learn from (row, column) presences; ``positive`` marks confirmed rows, ``prior`` is the share of toxic texts.

    Full-batch Adam on the non-negative risk with logistic loss. Without positives or unlabelled rows every
    score is the prior.
    """
    prior = float(np.clip(prior, 1e-4, 0.9))
    place = np.full(1 << HASH_BITS, -1)
    bias = float(np.log(prior / (1 - prior)))
    if not positive.any() or positive.all():
        return Detector(place, np.zeros(0), bias)
    columns = _select(row, column, positive, kept)
    place[columns] = np.arange(len(columns))
    inside = place[column] >= 0
    x = np.zeros((len(positive), len(columns) + 1), dtype=bool)
    x[row[inside], place[column[inside]]] = True
    x[:, -1] = True
    # Few texts have any kept word, so equal rows are counted and computed once.
    packed, which = np.unique(np.packbits(x, axis=1), axis=0, return_inverse=True)
    x = np.unpackbits(packed, axis=1, count=x.shape[1]).astype(np.float32)
    of_p = np.bincount(which.ravel()[positive], minlength=len(x)) / positive.sum()
    of_u = np.bincount(which.ravel()[~positive], minlength=len(x)) / (~positive).sum()
    w = np.zeros(x.shape[1])
    w[-1] = bias
    mean, square = np.zeros_like(w), np.zeros_like(w)

    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        # Risk of the negative class: log(1 + e^z) over unlabelled, less the prior's part of it over positives.
        loss = -np.log1p(-p)
        negative = of_u @ loss - prior * (of_p @ loss)
        up = (of_p * (p - 1)) @ x * prior
        down = ((of_u - prior * of_p) * p) @ x
        gradient = up + down if negative >= 0 else -down
        gradient[:-1] += decay * w[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Detector(place, w[:-1].copy(), float(w[-1]))


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Detector:
    """Learn from documents outside fold 0: confirmed toxic ones, and a sample of all as unlabelled.

    Each sample has at most ``sample_rows`` rows. The prior is the share of toxic ones among labelled rows. A document
    with different label rows counts by the larger; null labels and ids and labels of absent documents are ignored. Of several rows with one id the
    lowest list of words counts, so only one row per chosen id and sample reaches the driver.
    """
    labelled = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(fold() != 0)
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        # Before the prior and the sample: labels of other documents count for neither.
        .join(documents.select("doc_id"), "doc_id", "left_semi")
    )
    count, toxic = labelled.agg(F.count("*"), F.sum("toxic")).first()
    prior = ((toxic or 0) + 0.5) / ((count or 0) + 1)

    def sample(ids: DataFrame) -> DataFrame:
        return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    confirmed = sample(labelled.where("toxic = 1").select("doc_id"))
    others = documents.where("doc_id IS NOT NULL").where(fold() != 0).select("doc_id").distinct()
    chosen = confirmed.withColumn("positive", F.lit(True)).unionByName(
        sample(others).withColumn("positive", F.lit(False))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            row, column = present(part.column(2))
            ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(column.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["doc_id", "positive", "columns"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    described = (
        texts.join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "positive", "text")
        .mapInArrow(run, "doc_id long, positive boolean, columns array<int>")
    )
    one_each = described.groupBy("doc_id", "positive").agg(F.min("columns").alias("columns"))
    rows = one_each.toArrow().sort_by([("doc_id", "ascending"), ("positive", "ascending")]).combine_chunks()
    lists = rows["columns"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return fit(
        np.repeat(np.arange(len(sizes)), sizes),
        lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
        rows["positive"].to_numpy(),
        prior,
    )


def score(documents: DataFrame, detector: Detector) -> DataFrame:
    """(doc_id, score) of every document's whole text, however long; null counts as empty.

    Repeated rows give repeated results, a null doc_id stays null, other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(detector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            scores = shared.value.score(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], ["doc_id", "score"])

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    return chosen.mapInArrow(run, "doc_id long, score double")
