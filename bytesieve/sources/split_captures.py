"""Capture files read in byte ranges, so that one file is the work of many tasks.

Records have no marks, so a range first looks for an offset from which a chain of plausible record heads follows. That is a
guess: a payload may hold bytes that look like records. So every range is walked to the first record behind its end, and
a range counts only if it began where the range before it has ended. The first range of a file begins behind the file's
head, so in the end all ranges are right; those that were not are walked again from where they must begin.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytesieve.session import materialize
from bytesieve.sources.capture import (
    FILE_HEADER, FRAME_SCHEMA, FRAMES_AT_ONCE, MAGIC_MICRO, MAGIC_NANO, RECORD_HEADER, frames_as_pandas,
)
from bytesieve.sources.files import locate

SPLIT_BYTES = 64 << 20
# Bytes read at a time, and record heads that must follow each other before an offset is believed.
WINDOW, CHAIN = 1 << 20, 6
# Seconds by which the times of one file may lie apart before a head is thought implausible.
SPAN_SECONDS = 366 * 86_400
_HEAD = struct.calcsize("=" + FILE_HEADER)
_RECORD = struct.calcsize("=" + RECORD_HEADER)
# Ends of a walk: no record head was found in the range; the file is cut short or damaged.
UNKNOWN, DAMAGED = -1, -2
_SCANNED = "path string, length long, start long, stop long, first long, following long, records long"


class CaptureFile:
    """An open capture file: its byte order, its unit of time and its records from any offset."""

    def __init__(self, path: str, length: int):
        system, inner = locate(path)
        self.file, self.length = system.open_input_file(inner), length
        head = self.file.read_at(_HEAD, 0) if length >= _HEAD else b""
        for order in "<>":
            magic = struct.unpack_from(order + "I", head)[0] if head else 0
            if magic in (MAGIC_MICRO, MAGIC_NANO):
                break
        else:
            raise ValueError("not a capture file")
        self.order, self.unit = order, 1 if magic == MAGIC_NANO else 1_000
        self.snap = struct.unpack_from(order + FILE_HEADER, head)[5]
        self.record = struct.Struct(order + RECORD_HEADER)

    def records(self, at: int, stop: int) -> Iterator[tuple[int, int, bytes]]:
        """(offset behind it, time in nanoseconds, frame) of the records that begin at ``at`` and before ``stop``.

        Ends early where no whole record follows.
        """
        held, base = b"", at
        while at < stop and at + _RECORD <= self.length:
            if at + _RECORD > base + len(held):
                held, base = self.file.read_at(min(WINDOW, self.length - at), at), at
            seconds, fraction, stored, _ = self.record.unpack_from(held, at - base)
            if at + _RECORD + stored > self.length:
                return
            if at + _RECORD + stored > base + len(held):
                held, base = self.file.read_at(min(max(WINDOW, _RECORD + stored), self.length - at), at), at
            begin = at - base + _RECORD
            at += _RECORD + stored
            yield at, seconds * 1_000_000_000 + fraction * self.unit, held[begin : begin + stored]

    def believed(self, at: int) -> bool:
        """Whether a chain of plausible heads, or of fewer up to the end of the file, begins at ``at``."""
        for _ in range(CHAIN):
            if at == self.length:
                return True
            if at + _RECORD > self.length:
                return False
            seconds, fraction, stored, whole = self.record.unpack(self.file.read_at(_RECORD, at))
            near = abs(seconds - self.began) <= SPAN_SECONDS
            if not (near and fraction * self.unit < 1_000_000_000 and stored <= whole and stored <= max(self.snap, 1)):
                return False
            at += _RECORD + stored
        return at <= self.length

    def find_record(self, start: int, stop: int) -> int:
        """The first offset from ``start`` on and before ``stop`` that looks like a record's, else ``UNKNOWN``."""
        self.began = self.record.unpack(self.file.read_at(_RECORD, _HEAD))[0] if self.length >= _HEAD + _RECORD else 0
        for base in range(start, stop, WINDOW):
            data = np.frombuffer(self.file.read_at(min(WINDOW, stop - base) + _RECORD - 1, base), np.uint8).astype(np.int64)
            if len(data) < _RECORD:
                break
            shifts = (0, 8, 16, 24) if self.order == "<" else (24, 16, 8, 0)
            words = sum(data[i : len(data) - 3 + i] << shift for i, shift in enumerate(shifts))
            seconds, fraction, stored, whole = (words[i : len(words) - 12 + i] for i in (0, 4, 8, 12))
            plausible = (np.abs(seconds - self.began) <= SPAN_SECONDS) & (fraction * self.unit < 1_000_000_000)
            plausible &= (stored <= whole) & (stored <= max(self.snap, 1))
            for offset in np.flatnonzero(plausible):
                if self.believed(base + int(offset)):
                    return base + int(offset)
        return UNKNOWN


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk ranges (path, length, start, stop, due) from ``due``, or from where a record seems to begin if that is null."""
    for ranges in batches:
        rows = []
        for path, length, start, stop, due in ranges.itertuples(index=False, name=None):
            first = None if pd.isna(due) else int(due)
            if first is None or 0 <= first < stop:
                capture = CaptureFile(path, length)
                if first is None:
                    first = _HEAD if start == 0 else capture.find_record(start, stop)
            following, records = first, 0
            if 0 <= first < stop:
                for following, _, _ in capture.records(first, stop):
                    records += 1
                if following < min(stop, length):
                    following = DAMAGED
            rows.append((path, length, start, stop, first, following, records))
        yield pd.DataFrame(rows, columns=["path", "length", "start", "stop", "first", "following", "records"])


def _read(batches: Iterator[pd.DataFrame], damaged: str) -> Iterator[pd.DataFrame]:
    for ranges in batches:
        for path, length, first, stop, number, cut in ranges.itertuples(index=False, name=None):
            rows: list[tuple] = []
            at = first
            for at, ns, frame in CaptureFile(path, length).records(first, stop):
                rows.append((path, number, pd.Timestamp(ns // 1_000, unit="us", tz="UTC"), ns, frame))
                number += 1
                if len(rows) == FRAMES_AT_ONCE:
                    yield frames_as_pandas(rows)
                    rows = []
            if cut:
                if damaged != "mark":
                    raise ValueError(f"damaged capture file: no whole record at byte {at} of {length}")
                rows.append((path, number, None, None, None))
            if rows:
                yield frames_as_pandas(rows)


def read_split_captures(
    spark: SparkSession, path: str, pattern: str = "*.pcap", *, split_bytes: int = SPLIT_BYTES, damaged: str = "fail"
) -> DataFrame:
    """Frames of capture files of any size, as ``read_captures`` gives them, with a task per ``split_bytes``.

    Files are read twice, once for the heads of their records. Workers open them through a URI or a shared mount. Only the
    ranges' bounds are shuffled, a row each, and the rounds of repair end as soon as every range fits the one before.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0).cast("long")), F.lit(split_bytes).cast("long"))
    ranges = files.select("path", "length", F.explode(starts).alias("start")).withColumn(
        "stop", F.least(F.col("start") + split_bytes, F.greatest("length", F.lit(1)))
    )
    ranges = materialize(ranges, "ranges")
    tasks = max(1, ranges.count())
    asked = ["path", "length", "start", "stop", "due"]
    first_look = ranges.withColumn("due", F.lit(None).cast("long")).select(*asked).repartition(tasks)
    scanned = materialize(first_look.mapInPandas(_scan, _SCANNED), "scanned")
    before = Window.partitionBy("path").orderBy("start")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    # Ranges inside a long record hold no head; the range behind them is due where the record ends.
    ended = F.when(F.col("following") != UNKNOWN, F.col("following"))
    passed = (F.col("first") == UNKNOWN) & ((F.col("due") >= F.col("stop")) | (F.col("due") == DAMAGED))
    while True:
        linked = materialize(scanned.withColumn("due", F.last(ended, ignorenulls=True).over(earlier)), "linked")
        fits = F.col("due").isNull() | (F.col("due") == F.col("first")) | passed
        wrong = linked.where(~fits).select(*asked)
        count = wrong.count()
        if not count:
            break
        again = wrong.repartition(count).mapInPandas(_scan, _SCANNED)
        scanned = materialize(linked.where(fits).drop("due").unionByName(again), "scanned")
    numbered = linked.withColumn("number", F.coalesce(F.sum("records").over(earlier), F.lit(0)))
    # A range in which the file breaks off; the ranges behind it are due where nothing begins.
    cut = (F.col("following") == DAMAGED) & (F.col("first") >= 0)
    wanted = numbered.where((F.col("records") > 0) | cut).select("path", "length", "first", "stop", "number", cut.alias("cut"))
    return wanted.repartition(tasks).mapInPandas(lambda batches: _read(batches, damaged), FRAME_SCHEMA)
