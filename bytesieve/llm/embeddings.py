"""Embedding near duplicates by collision-counting projections.

Vectors are projected on many random lines. Two vectors collide on a line if one lies in the window centred on the
other; windows are read off the sorted projections. Pairs that collide on enough lines, a number set so that pairs at
the threshold are missed with a small known chance, are verified by their exact cosine.

Windows alone hold a constant share of all pairs, so lines are sorted within cells: vectors with one sign code under
one of several tables. The number of tables is set for the same small chance of a miss, and a pair is counted in the
first table only in which it shares a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.llm.common import components, spanning_forest
from bytesieve.session import materialize

COSINE = 0.9
LINES = 32
SEED = 7
# Vectors that a cell holds, about, and that one side of a block holds at most, about.
CELL = 2048
# Chance that a pair exactly at the threshold shares no cell, and that it collides too seldom.
MISS_CELL, MISS_COUNT = 0.002, 0.001


@dataclass(frozen=True)
class Plan:
    """Numbers that follow from the threshold and the number of vectors."""

    cosine: float
    bits: int
    tables: int
    window: float
    collisions: int

    @staticmethod
    def of(vectors: int, cosine: float = COSINE, cell: int = CELL) -> Plan:
        bits = max(0, ceil(log2(max(1, vectors) / cell)))
        together = (1 - acos(cosine) / pi) ** bits
        tables = 1 if together >= 1 else ceil(log(MISS_CELL) / log(1 - together))
        # The difference of unit vectors at the threshold has a normal projection of this deviation.
        deviation = sqrt(2 - 2 * cosine)
        window = 2 * deviation
        p = erf(window / deviation / sqrt(2))
        tail, least = 0.0, LINES
        for count in range(LINES, -1, -1):
            tail += comb(LINES, count) * p**count * (1 - p) ** (LINES - count)
            least = count
            if tail >= 1 - MISS_COUNT:
                break
        return Plan(cosine, bits, tables, window, least)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    rows = vectors.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _lines(size: int, number: int, purpose: int) -> np.ndarray:
    return np.random.default_rng((SEED, purpose, size)).standard_normal((size, number))


def codes(rows: np.ndarray, plan: Plan) -> np.ndarray:
    """The cell of each unit vector under each table: its signs on the table's lines."""
    signs = rows @ _lines(rows.shape[1], plan.bits * plan.tables, 1) > 0
    weights = 1 << np.arange(plan.bits, dtype=np.int64)
    return signs.reshape(len(rows), plan.tables, plan.bits) @ weights


def colliding_pairs(a: np.ndarray, b: np.ndarray, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of unit vectors in ``a`` and ``b`` with enough collisions, for some rows of ``a`` at a time."""
    lines = _lines(a.shape[1], LINES, 2)
    on_a, on_b = a @ lines, b @ lines
    order = np.argsort(on_b, axis=0, kind="stable")
    ranks = np.empty(on_b.shape, np.int32)
    np.put_along_axis(ranks, order, np.arange(len(b), dtype=np.int32)[:, None], axis=0)
    ordered = np.take_along_axis(on_b, order, axis=0)
    for start in range(0, len(a), 256):
        query = on_a[start : start + 256]
        counts = np.zeros((len(query), len(b)), np.uint8)
        for line in range(LINES):
            first = np.searchsorted(ordered[:, line], query[:, line] - plan.window, side="left").astype(np.int32)
            last = np.searchsorted(ordered[:, line], query[:, line] + plan.window, side="right").astype(np.int32)
            rank = ranks[:, line]
            # Rank within [first, last), by one unsigned comparison.
            counts += (rank[None, :] - first[:, None]).view(np.uint32) < (last - first).view(np.uint32)[:, None]
        i, j = np.nonzero(counts >= plan.collisions)
        yield i + start, j


def linked_pairs(a: np.ndarray, b: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with a cosine of the threshold at least, among the colliding ones."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in colliding_pairs(a, b, plan):
        for start in range(0, len(i), 16_384):
            part = slice(start, start + 16_384)
            near = np.einsum("ij,ij->i", a[i[part]], b[j[part]]) >= plan.cosine
            left.append(i[part][near])
            right.append(j[part][near])
    return np.concatenate(left), np.concatenate(right)


def _block(table: pa.Table, plan: Plan) -> pa.RecordBatch:
    """Links within one block: (a, b, links), b null in rows that count the links of a."""
    ids, weight = table["id"].to_numpy(), table["n"].to_numpy()
    rows = unit(np.array(table["embedding"].to_pylist(), dtype=np.float64))
    cells = np.array(table["codes"].to_pylist(), dtype=np.int64).reshape(len(ids), plan.tables)
    number, part = table["number"][0].as_py(), table["part"].to_numpy()
    order = np.lexsort((ids, part))
    ids, weight, rows, cells, part = ids[order], weight[order], rows[order], cells[order], part[order]
    one = table["i"][0].as_py() == table["j"][0].as_py()
    # Between two parts only pairs across count; within one part, all.
    cut = len(ids) if one else int((part == table["i"][0].as_py()).sum())
    left, right = linked_pairs(rows[:cut], rows if one else rows[cut:], plan)
    right = right if one else right + cut
    keep = (left < right) & ~(cells[left, :number] == cells[right, :number]).any(axis=1)
    left, right = left[keep], right[keep]
    links = np.bincount(left, weight[right], len(ids)) + np.bincount(right, weight[left], len(ids))
    counted = np.flatnonzero(links)
    a, b = spanning_forest(len(ids), left, right)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([ids[counted], ids[a]])),
            pa.array(np.concatenate([np.zeros(len(counted), np.int64), ids[b]]),
                     mask=np.arange(len(counted) + len(a)) < len(counted)),
            pa.array(np.concatenate([links[counted].astype(np.int64), np.zeros(len(a), np.int64)])),
        ],
        ["a", "b", "links"],
    )


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector of ``embeddings`` (vec_id, embedding).

    Vectors of one length are linked at a cosine of ``cosine`` or more; n_links counts all other vectors linked
    directly, component_id is the smallest vec_id reachable. Null, empty and zero vectors and those with null or
    non-finite components link with nothing. Several rows of one vec_id are one vector, the smallest array of them;
    rows without
    vec_id are one vector that links with nothing and has no component. Equal vectors are compared once. Other columns
    are ignored; an empty table gives no rows.
    """
    vectors = materialize(embeddings.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    distinct = materialize(
        usable.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vectors-distinct"
    )
    plan = Plan.of(distinct.count(), cosine, cell)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                part = whole.slice(start, 4096)
                values = part.column(0).to_pylist()
                found: list = [None] * len(values)
                sizes = np.array([len(v) for v in values])
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    for i, c in zip(at, codes(unit(np.array([values[i] for i in at])), plan), strict=True):
                        found[i] = c
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.list_(pa.int64()))], [*part.schema.names, "codes"]
                )

    kind = distinct.schema["embedding"].dataType.simpleString()
    coded = distinct.mapInArrow(code, f"embedding {kind}, id long, n long, codes array<long>")
    cells = coded.select(
        "id", "n", "embedding", "codes", F.size("embedding").alias("size"), F.posexplode("codes").alias("number", "code")
    )
    keys = ["number", "size", "code"]
    counted = materialize(cells.groupBy(*keys).agg(F.count("*").alias("count")).where("count > 1"), "vector-cells")
    parts = F.ceil(F.col("count") / (2 * cell))
    dealt = (
        cells.join(counted, keys)
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _block(pa.Table.from_batches(batches), plan)

    blocks = materialize(
        dealt.select(*keys, "i", "j", "id", "n", "embedding", "codes", "part")
        .groupBy(*keys, "i", "j")
        .applyInArrow(run, "a long, b long, links long"),
        "vector-links",
    )
    links = blocks.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    linked = components(blocks.where("b IS NOT NULL"), "vectors").withColumnRenamed("node", "id")
    result = materialize(
        distinct.join(links, "id", "left").join(linked, "id", "left").select(
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        ),
        "vector-components",
    )
    rest = vectors.join(usable.select(F.col("vec_id").alias("_usable")), F.col("vec_id") == F.col("_usable"), "left_anti")
    return (
        usable.join(result, "embedding")
        .select("vec_id", "n_links", "component_id")
        .unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
