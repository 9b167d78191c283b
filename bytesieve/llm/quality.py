"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; the score is the sum of one table entry per feature and one per pair of
features. Tables are learned by cyclic boosting: in turn, each feature (later each chosen pair) gets a shallow tree
over its bins, fitted to what the others leave, and the trees add up to the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.llm.common import fold, slices, text_or_empty

# Labelled rows that are learned from, at most; chosen by a hash of the id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3

FEATURES = (
    "log_bytes log_words lower upper digit space newline other_ascii non_ascii hash_like bar exclaim comma stop "
    "word_bytes longest_word distinct_words repeated_next short_words line_bytes repeated_lines compressed"
).split()


def features(raw: bytes, compressor) -> list[float]:
    """Numbers that describe one whole text; all zero for an empty one."""
    if not raw:
        return [0.0] * len(FEATURES)
    size = len(raw)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lower, upper = int(seen[97:123].sum()), int(seen[65:91].sum())
    digit, space, newline = int(seen[48:58].sum()), int(seen[32]), int(seen[10])
    other = int(seen[128:].sum())
    words = raw.split()
    count = max(1, len(words))
    sizes = list(map(len, words))
    lines = raw.split(b"\n")
    signs = int(seen[[35, 36, 37, 38, 42]].sum())
    return [
        np.log1p(size), np.log1p(len(words)), lower / size, upper / size, digit / size, space / size, newline / size,
        (size - lower - upper - digit - space - newline - other) / size, other / size, signs / count,
        int(seen[124]) / count, int(seen[33]) / count, int(seen[44]) / count, int(seen[46]) / count,
        sum(sizes) / count, max(sizes, default=0), len(set(words)) / count, sum(map(eq, words, words[1:])) / count,
        sum(map((4).__gt__, sizes)) / count, size / len(lines), 1 - len(set(lines)) / len(lines),
        len(compressor.compress(raw)) / size,
    ]


def _compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=1)


def _feature_rows(part: pa.RecordBatch, compressor, column: int = 1) -> np.ndarray:
    rows = [features(raw, compressor) for raw in part.column(column).cast(pa.binary()).to_pylist()]
    return np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class Additive:
    """Bin edges and tables of an additive model with pairs."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, rows[:, j], side="right") for j, e in enumerate(self.edges)])

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row: one addition per feature and pair."""
        bins = self.bins(rows)
        total = np.full(len(rows), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for a, b, table in self.pairs:
            total += table[bins[:, a], bins[:, b]]
        return 1 / (1 + np.exp(-total))


def _best_cut(gradient: np.ndarray, weight: np.ndarray, least: float) -> tuple[float, int]:
    """(gain, cut) of the best split of consecutive bins in two; cut 0 if there is none."""
    g, h = np.cumsum(gradient), np.cumsum(weight)
    left_g, left_h = g[:-1], h[:-1]
    right_g, right_h = g[-1] - left_g, h[-1] - left_h
    ok = (left_h >= least) & (right_h >= least)
    if not ok.any():
        return 0.0, 0
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g[-1] ** 2 / (h[-1] + 1)
    gain[~ok] = -1
    cut = int(np.argmax(gain))
    return float(gain[cut]), cut + 1 if gain[cut] > 0 else 0


def _tree(gradient: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """Step per bin of a tree with up to three leaves over consecutive bins."""
    bounds = [0, len(gradient)]
    _, cut = _best_cut(gradient, weight, least)
    if cut:
        sides = [(cut, 0, cut), (cut, cut, len(gradient))]
        gains = [(*_best_cut(gradient[a:b], weight[a:b], least), a) for _, a, b in sides]
        gain, further, start = max(gains)
        bounds = sorted({0, cut, len(gradient), start + further if gain > 0 and further else cut})
    step = np.empty(len(gradient))
    for a, b in zip(bounds, bounds[1:], strict=False):
        step[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + 1)
    return step


def _quadrants(gradient: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """Step per cell of a tree that cuts each of two features once, at the best pair of cuts."""
    g, h = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (gradient, weight))

    def corners(sums: np.ndarray) -> list[np.ndarray]:
        """Sums of the four parts for every pair of cuts."""
        low, row, column, whole = sums[1:-1, 1:-1], sums[1:-1, -1:], sums[-1:, 1:-1], sums[-1, -1]
        return [low, row - low, column - low, whole - row - column + low]

    gain = sum(x * x / (w + 1) for x, w in zip(corners(g), corners(h), strict=True))
    gain = np.where(np.minimum.reduce(corners(h)) >= least, gain, -1)
    row, column = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = np.zeros_like(gradient)
    if gain[row, column] > 0:
        for a in (slice(0, row + 1), slice(row + 1, None)):
            for b in (slice(0, column + 1), slice(column + 1, None)):
                step[a, b] = gradient[a, b].sum() / (weight[a, b].sum() + 1)
    return step


def fit(
    rows: np.ndarray, labels: np.ndarray, *, bins: int = 48, rounds: int = 120, pair_rounds: int = 40,
    pairs: int = 8, rate: float = 0.15,
) -> Additive:
    """Learn the tables. Without rows or with one class only, every score is the smoothed share of label 1."""
    prior = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.5
    edges = []
    for j in range(len(FEATURES)):
        cuts = np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1]) if len(rows) else np.zeros(0)
        edges.append(np.unique(cuts))
    model = Additive(edges, float(np.log(prior / (1 - prior))), [np.zeros(len(e) + 1) for e in edges])
    if len(rows) < 2 or labels.min() == labels.max():
        return model
    binned = model.bins(rows)
    total = np.full(len(rows), model.intercept)
    least = max(1.0, 0.0005 * len(rows) * 0.25)

    def errors() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            if len(table) < 2:
                continue
            residual, weight = errors()
            step = rate * _tree(
                np.bincount(binned[:, j], residual, len(table)), np.bincount(binned[:, j], weight, len(table)), least
            )
            table += step
            total += step[binned[:, j]]

    def cells(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.tables[a]), len(model.tables[b]))
        place = binned[:, a] * shape[1] + binned[:, b]
        residual, weight = errors()
        size = shape[0] * shape[1]
        return np.bincount(place, residual, size).reshape(shape), np.bincount(place, weight, size).reshape(shape), place

    strength = []
    for a in range(len(FEATURES)):
        for b in range(a + 1, len(FEATURES)):
            if len(model.tables[a]) > 1 and len(model.tables[b]) > 1:
                gradient, weight, _ = cells(a, b)
                step = _quadrants(gradient, weight, least)
                strength.append((float((gradient * step).sum()), a, b))
    for _, a, b in sorted(strength, reverse=True)[:pairs]:
        model.pairs.append((a, b, np.zeros((len(model.tables[a]), len(model.tables[b])))))
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            gradient, weight, place = cells(a, b)
            step = rate * _quadrants(gradient, weight, least)
            table += step
            total += step.ravel()[place]
    return model


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Additive:
    """Learn from labelled documents outside fold 0, at most ``sample_rows`` of them.

    A document whose label rows differ counts by the larger; null labels and ids are ignored, and so are labels of
    documents that are not there. Of several rows with one id the lowest numbers count, so only one row per chosen id
    reaches the driver.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(fold() != 0)
        .groupBy("doc_id")
        .agg(F.max(F.col("quality").cast("int")).alias("label"))
        # Before the limit: labels of other documents must not use it up.
        .join(documents.select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = _compressor()
        for part in slices(batches):
            values = list(_feature_rows(part, compressor))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "label", "values"]
            )

    chosen = documents.select("doc_id", text_or_empty()).join(F.broadcast(known), "doc_id")
    described = chosen.select("doc_id", "text", "label").mapInArrow(
        run, "doc_id long, label int, values array<double>"
    )
    one_each = described.groupBy("doc_id", "label").agg(F.min("values").alias("values"))
    rows = sorted((r["doc_id"], r["label"], r["values"]) for r in one_each.collect())
    return fit(
        np.array([r[2] for r in rows], dtype=np.float64).reshape(-1, len(FEATURES)),
        np.array([r[1] for r in rows], dtype=np.float64),
    )


def score(documents: DataFrame, model: Additive) -> DataFrame:
    """(doc_id, score) of every document's whole text, however long; null counts as empty.

    Repeated rows give repeated results, a null doc_id stays null, other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = _compressor()
        for part in slices(batches):
            scores = shared.value.score(_feature_rows(part, compressor))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], ["doc_id", "score"])

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    return chosen.mapInArrow(run, "doc_id long, score double")


def keep_good(documents: DataFrame, model: Additive, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, with all their columns, whose text scores ``threshold`` or more."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = _compressor()
        for part in slices(batches):
            texts = part.set_column(place, "text", part.column(place).fill_null(""))
            yield part.filter(pa.array(shared.value.score(_feature_rows(texts, compressor, place)) >= threshold))

    return documents.mapInArrow(run, documents.schema)
