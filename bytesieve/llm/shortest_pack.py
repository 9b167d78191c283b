"""Shortest-pack-first packing over the histogram of lengths, with free cuts and no padding.

The plan is made over counts alone: lengths are placed longest first, each into the packs that hold least so far, and
packs that look alike are one row with a count. Its size depends on the capacity, not on the number of documents.
Documents get a rank among those of their length and find their places in the plan by that rank.

The packs are given from the start: as many full sequences as the tokens fill, and for the rest one sequence for every
bit of the rest's number, which need no padding since their lengths are powers of two. So a length that fits in no open
pack is cut: its head fills the shortest pack and its tail is placed later, among the shorter lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytesieve.llm.common import slices, text_or_empty
from bytesieve.llm.packing import WordTokenizer
from bytesieve.session import materialize

# The id that ends every document.
END_ID = 2
# Units of one length that are ranked together; a more frequent length is dealt into several buckets.
BUCKET_UNITS = 1 << 14
PLAN_FIELDS = ("length", "skip", "rank", "ranks", "first", "packs", "sequence", "offset", "size")

_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def units_of(documents: DataFrame, tokenizer_path: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, doc_tokens, crc, ids): token ids and the end id of each document, at most ``capacity`` a row.

    ``ids`` is binary, little-endian, of 16 bits where the vocabulary allows it. A unit of ``capacity`` is a sequence of its
    own and never cut, so its ids stay behind unless ``with_ids`` asks for them; ``crc`` is that of all of them. Null and
    blank texts are the end id alone; repeated rows give repeated units, a null doc_id stays null, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        kind = id_type(tokenizer.tokenizer.get_vocab_size())
        for part in slices(batches, size=6 << 20):
            ids, bounds = tokenizer.encode(part.column(1))
            ids = np.insert(ids, bounds[1:], END_ID).astype(kind)
            bounds = bounds + np.arange(len(bounds))
            sizes = np.diff(bounds)
            units = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), units)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(units) - units, units)) * capacity
            length = np.minimum(capacity, sizes[row] - start)
            ends = np.cumsum(length)
            wide = ids.astype("<u4")
            sums = [zlib.crc32(wide[end - n : end]) for end, n in zip(ends.tolist(), length.tolist(), strict=True)]
            # The units of a slice lie one after another, as their ids do.
            kept = np.ones(len(row), bool) if with_ids else length < capacity
            ids = ids[np.repeat(kept, length)]
            offsets = np.concatenate([[0], np.cumsum(np.where(kept, length, 0))]) * ids.itemsize
            packed = pa.Array.from_buffers(
                pa.binary(), len(row), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.tobytes())]
            )
            columns = [part.column(0).take(pa.array(row)), *map(pa.array, (start, length, sizes[row], sums)), packed]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "crc", "ids"])

    schema = "doc_id long, start long, length long, doc_tokens long, crc long, ids binary"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).mapInArrow(run, schema)


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """The plan for ``histogram`` (length -> number of units): one row of ``PLAN_FIELDS`` per set of like placements.

    A row places ids ``skip`` to ``skip + size`` of the units of ``length`` with ranks from ``rank`` on, ``ranks`` of
    them: unit ``rank + i`` is number ``first + i`` of its set, which goes to sequence ``sequence + number % packs``
    at ``offset + number // packs * size``. All sequences are filled to the last place.
    """
    total = sum(length * count for length, count in histogram.items())
    whole, rest = divmod(total, capacity)
    rooms = [(0, whole, capacity)] if whole else []
    for bit in range(rest.bit_length()):
        if rest >> bit & 1:
            rooms.append((rooms[-1][0] + rooms[-1][1] if rooms else 0, 1, 1 << bit))
    first, packs, size = np.array(rooms, np.int64).reshape(-1, 3).T.copy()
    left = size.copy()
    blocks: dict[int, list[tuple[int, int, int, int]]] = {n: [(n, 0, c, 0)] for n, c in histogram.items() if c}
    units: list[tuple[int, int, int, int]] = []
    plan: list[tuple[int, ...]] = []
    waiting = 0

    def place(i: int, copies: int, used: int) -> None:
        """Lay pieces of ``used`` ids of the next units into the packs of row ``i``, ``copies`` each."""
        nonlocal waiting
        number, wanted = 0, copies * int(packs[i])
        while number < wanted:
            origin, rank, count, skip = units.pop()
            n = min(count, wanted - number)
            plan.append((origin, skip, rank, n, number, int(packs[i]), int(first[i]), int(size[i] - left[i]), used))
            if used < length:
                blocks.setdefault(length - used, []).append((origin, rank, n, skip + used))
            if n < count:
                units.append((origin, rank + n, count - n, skip))
            number += n
        left[i] -= copies * used
        waiting -= wanted

    def split(i: int, head: int) -> None:
        """Cut the packs of row ``i`` in the first ``head`` and the others, which become the last row."""
        nonlocal first, packs, size, left
        first, size, left = np.append(first, first[i] + head), np.append(size, size[i]), np.append(left, left[i])
        packs = np.append(packs, packs[i] - head)
        packs[i] = head

    def fill(rows: np.ndarray) -> None:
        """Fill packs to the last place by one piece each, a head of it if the length is longer."""
        for i in rows.tolist():
            if not waiting:
                break
            if packs[i] > waiting:
                split(i, waiting)
            place(i, 1, int(left[i]))

    def pieces_above(room: int) -> np.ndarray:
        """How many pieces each pack takes if all go where at least ``room`` is left."""
        return np.where(left >= room, (left - room) // length + 1, 0)

    for length in range(capacity, 0, -1):
        units = blocks.pop(length, [])
        waiting = sum(count for _, _, count, _ in units)
        if not waiting:
            continue
        # Packs that the length fills to the last place are closed first.
        fill(np.flatnonzero(left == length))
        # Each piece goes to the shortest pack: of all rooms (left, left - length, ...) the largest are taken.
        low, high = length, capacity + 1
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if int((pieces_above(middle) * packs).sum()) <= waiting else (middle + 1, high)
        copies = pieces_above(low)
        rest = waiting - int((copies * packs).sum())
        for i in np.flatnonzero(pieces_above(low - 1) > copies).tolist() if low > length else []:
            if not rest:
                break
            if packs[i] > rest:
                split(i, rest)
                copies = np.append(copies, copies[i])
            copies[i] += 1
            rest -= int(packs[i])
        for i in np.flatnonzero(copies).tolist():
            place(i, int(copies[i]), length)
        # No open pack has room: the shortest ones are filled with heads, the tails wait among shorter lengths.
        fill(np.argsort(-left, kind="stable"))
        opened = left > 0
        first, packs, size, left = first[opened], packs[opened], size[opened], left[opened]
    return np.array(plan, np.int64).reshape(-1, len(PLAN_FIELDS))


class Places:
    """A plan to be asked for the places of units by length and rank."""

    def __init__(self, plan: np.ndarray, capacity: int):
        self.plan = plan[np.lexsort([plan[:, 2], plan[:, 1], plan[:, 0]])]
        key = self.plan[:, 0] * (capacity + 1) + self.plan[:, 1]
        self.keys, group = np.unique(key, return_inverse=True)
        # Ranks stay far below 2^40, and there are fewer keys than 2^23.
        self.order = (group.astype(np.int64) << 40) + self.plan[:, 2]
        self.capacity = capacity

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
        """(unit, skip, size, sequence, offset) of all pieces, in the order of units and, within them, of ids."""
        unit, skip = np.arange(len(lengths)), np.zeros(len(lengths), np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        while len(unit):
            group = np.searchsorted(self.keys, lengths[unit] * (self.capacity + 1) + skip)
            row = self.plan[np.searchsorted(self.order, (group << 40) + ranks[unit], side="right") - 1]
            number = row[:, 4] + ranks[unit] - row[:, 2]
            sequence, offset = row[:, 6] + number % row[:, 5], row[:, 7] + number // row[:, 5] * row[:, 8]
            found.append((unit, skip, row[:, 8], sequence, offset))
            skip = skip + row[:, 8]
            more = skip < lengths[unit]
            unit, skip = unit[more], skip[more]
        if not found:
            return (np.zeros(0, np.int64),) * 5
        columns = [np.concatenate(column) for column in zip(*found, strict=True)]
        order = np.lexsort([columns[1], columns[0]])
        return tuple(column[order] for column in columns)


def ranked(units: DataFrame, bucket_units: int = BUCKET_UNITS) -> tuple[DataFrame, dict[int, int]]:
    """``units`` (a stored table) with the rank of each among those of its length, and the histogram of lengths.

    A length is dealt by hash into buckets, so a length of a third of all units is ranked in many tasks. Units with
    equal columns are interchangeable, whichever way a retry ranks them. Only the histogram, with at most as many rows as
    the capacity has places, reaches the driver.
    """
    buckets = max(1, -(-units.count() // bucket_units))
    dealt = units.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "crc"), F.lit(buckets)).cast("int"))
    counts = materialize(dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("units")), "lengths")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("units").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "crc", "doc_tokens")
    rank = F.col("base") + F.row_number().over(within) - 1
    sums = counts.groupBy("length").agg(F.sum("units").alias("units")).collect()
    frame = dealt.join(bases, ["length", "bucket"]).withColumn("rank", rank).drop("bucket", "base")
    return frame, {row["length"]: row["units"] for row in sums}


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of the pieces of all documents.

    Every sequence is full: it has ``capacity`` tokens, or for the last few a smaller power of two of them. Documents longer
    than ``capacity`` are cut at its multiples, and units that fit nowhere are cut once more. Null and blank texts are the
    end id alone, repeated rows are packed each, a null doc_id stays null, other columns are ignored, an empty table gives
    no rows. A text of any length is one row of one task, cut in units there.
    """
    from tokenizers import Tokenizer

    kind = id_type(Tokenizer.from_file(tokenizer_path).get_vocab_size())
    units, histogram = ranked(materialize(units_of(documents, tokenizer_path, capacity, with_ids), "units"))
    plan = shortest_pack_first(histogram, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(plan, capacity)
        for part in slices(batches, "ids"):
            values = {name: part.column(name) for name in part.schema.names}
            lengths, ranks = values["length"].to_numpy(), values["rank"].to_numpy()
            unit, skip, size, sequence, offset = places.of(lengths, ranks)
            stored = values["ids"].to_pylist()
            whole = (size == lengths[unit]).tolist()
            sums, cuts = values["crc"].to_numpy()[unit].tolist(), []
            for i, (u, a, n) in enumerate(zip(unit.tolist(), skip.tolist(), size.tolist(), strict=True)):
                if with_ids or not whole[i]:
                    cut = np.frombuffer(stored[u], kind)[a : a + n].astype("<u4")
                    sums[i] = zlib.crc32(cut)
                    cuts.append(cut)
            arrays = [
                values["doc_id"].take(pa.array(unit)),
                pa.array(values["start"].to_numpy()[unit] + skip),
                pa.array(size),
                pa.array(sums, pa.int64()),
                values["doc_tokens"].take(pa.array(unit)),
                pa.array(sequence),
                pa.array(offset),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([cut.astype(np.int64) for cut in cuts], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return units.mapInArrow(run, schema + ", ids array<long>" * with_ids)
