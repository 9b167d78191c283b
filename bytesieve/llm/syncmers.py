"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest hash among its inner s-mers belongs to the first or the last of
them. That depends on the k-mer alone, so equal passages have equal anchors wherever they stand. A fingerprint is
the sorted list of the smallest anchor hashes; likeness estimates the share of anchors that two texts have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.llm.common import slices, text_or_empty

K, S = 24, 10
# Anchor hashes in a fingerprint, at most; 8 hex digits each.
KEPT = 64
# Documents in a run of neighbours that one task follows, about, and the most runs.
RUN_ROWS, MOST_RUNS = 1000, 8192

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {1: _BASE}
for _n in (2, 4, 8, 16):
    with np.errstate(over="ignore"):
        _POWERS[_n] = _POWERS[_n // 2] * _POWERS[_n // 2]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _roll(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all S-mers and all K-mers (S = 10, K = 24), by doubling the length covered."""
    h = _mix((codes.astype(np.uint64) + np.uint64(1)) * _BASE)
    runs = {1: h}
    for n in (1, 2, 4, 8):
        runs[2 * n] = runs[n][:-n] * _POWERS[n] + runs[n][n:]
    inner = runs[8][: len(codes) - 9] * _POWERS[2] + runs[2][8:]
    outer = runs[16][: len(codes) - 23] * _POWERS[8] + runs[8][16:]
    return _mix(inner), _mix(outer)


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the closed syncmers of ``text`` in code points; none in a text below K."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(codes) < K:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inner, outer = _roll(codes)
    low = inner
    for n in (1, 2, 4):
        low = np.minimum(low[:-n], low[n:])
    # Windows of 8 cover the K - S + 1 = 15 inner places.
    low = np.minimum(low[:-7], low[7:])
    at = np.flatnonzero((inner[: len(low)] == low) | (inner[K - S :] == low))
    return at, outer[at]


def sketch(text: str) -> np.ndarray:
    """The smallest anchor hashes, sorted, 32 bits each; a text without anchors has the hash of the whole."""
    hashes = np.unique(anchors(text)[1] >> np.uint64(32))[:KEPT]
    if len(hashes):
        return hashes.astype(np.uint32)
    return np.frombuffer(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:4], dtype=">u4").astype(np.uint32)


def as_string(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among the smallest of both sketches together: 0 to 1."""
    together = np.union1d(a, b)[:KEPT]
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(common, together).sum() / len(together))


def anchor_table(documents: DataFrame) -> DataFrame:
    """(doc_id, position, anchor): every anchor of every document, to match passages by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size=1 << 20):
            found = [anchors(text) for text in part.column(1).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(at) for at, _ in found])
            at = np.concatenate([at for at, _ in found]).astype(np.int64)
            anchor = np.concatenate([h for _, h in found]).astype(np.uint64).view(np.int64)
            ids = part.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(anchor)], ["doc_id", "position", "anchor"])

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    return chosen.mapInArrow(run, "doc_id long, position long, anchor long")


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_with_edits(documents: DataFrame) -> DataFrame:
    """Fingerprints of every document, of an edited version and of the next one, with their likeness (``SCHEMA``).

    The next document is the one with the next smaller doc_id; the largest follows the smallest. The edited text has the
    last third (rounded down) replaced by as much of the next one's beginning. Null text is empty. Rows with
    one doc_id follow each other in the order of their compressed texts. A row without doc_id
    has no neighbour: an empty text stands for its next one. An empty table gives no rows.

    Neighbours are brought together by one shuffle of compressed texts into runs of ids; the largest document of
    a run also goes to the end of the run above, so no run needs another.
    """
    ids = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    count, largest = ids.agg(F.count("*"), F.max("doc_id")).first()
    runs = min(max(1, count // RUN_ROWS), MOST_RUNS)
    tops = np.zeros(0, np.int64)
    if count:
        shares = [i / runs for i in range(1, runs)]
        cuts = ids.agg(F.percentile_approx("doc_id", shares, 100 * runs)).first()[0] if shares else []
        tops = np.unique(np.array([*cuts, largest], dtype=np.int64))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the number of their run, texts compressed; run k holds the ids up to ``tops[k]``."""
        import zstandard

        compressor = zstandard.ZstdCompressor(level=1)
        for part in slices(batches):
            texts = [compressor.compress(raw) for raw in part.column(1).cast(pa.binary()).to_pylist()]
            known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
            doc = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            run = np.where(known, np.searchsorted(tops, doc), -1 - np.arange(len(doc)) % 64)
            extra = np.flatnonzero(known & np.isin(doc, tops))
            row = np.concatenate([np.arange(len(doc)), extra])
            upper = (run[extra] + 1) % max(1, len(tops))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([run, upper])),
                    pa.array(np.arange(len(row)) >= len(doc)),
                    part.column(0).take(pa.array(row)),
                    pa.array(texts, pa.binary()).take(pa.array(row)),
                ],
                ["run", "lead", "doc_id", "packed"],
            )

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order: each is finished when the row behind it is known."""
        import zstandard

        decompressor = zstandard.ZstdDecompressor()
        before = None  # run, doc_id, text, sketch
        rows: list[tuple] = []

        def finished(doc: int | None, text: str, own: np.ndarray, other: str, others: np.ndarray) -> tuple:
            third = len(text) // 3
            edited = text[: len(text) - third] + other[:third]
            changed = sketch(edited)
            digest = hashlib.sha256(edited.encode("utf-8")).hexdigest()
            near = likeness(own, changed), likeness(own, others)
            return doc, len(text), digest, as_string(own), as_string(changed), *near

        names = [part.split()[0] for part in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def batch() -> pa.RecordBatch:
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for part in batches:
            columns = (column.to_pylist() for column in part.columns)
            for run, lead, doc, packed in zip(*columns, strict=True):
                if lead and (before is None or before[0] != run):
                    continue  # a further row with the id that the run above has followed already
                text = decompressor.decompress(packed).decode()
                own = sketch(text)
                if before is not None and before[0] == run:
                    rows.append(finished(*before[1:], text, own))
                if run < 0:
                    rows.append(finished(doc, text, own, "", sketch("")))
                before = None if lead or run < 0 else (run, doc, text, own)
                if len(rows) >= 1000:
                    yield batch()
        if rows:
            yield batch()

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    routed = chosen.mapInArrow(route, "run long, lead boolean, doc_id long, packed binary")
    ordered = routed.repartition("run").sortWithinPartitions("run", "lead", F.desc_nulls_last("doc_id"), "packed")
    return ordered.mapInArrow(follow, SCHEMA)
