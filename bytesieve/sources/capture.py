"""Classic capture files: frame reader and a Python data source that writes them."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from bytesieve.operators.order import global_rank
from bytesieve.sources.files import locate

# Fixed values of the capture file format.
MAGIC_MICRO = 0xA1B2C3D4
MAGIC_NANO = 0xA1B23C4D
FILE_HEADER = "IHHiIII"
RECORD_HEADER = "IIII"
LINKTYPE_ETHERNET = 1
SNAPLEN = 262_144

FRAME_SCHEMA = "path string, packet_no long, ts timestamp, ts_ns long, frame binary"
# Frames handed to Spark at a time.
FRAMES_AT_ONCE = 4_096
# Bytes after which a task goes on in a next file, as files are read whole.
ROLL_BYTES = 16 << 20


def split_records(content: bytes | memoryview, damaged: str = "fail") -> Iterator[tuple[int | None, bytes | None]]:
    """(time in nanoseconds, frame) of each record; raises on a foreign file.

    A record that does not fit the file makes the rest of it unreadable. That raises with ``damaged`` "fail"; with
    "mark" one last (None, None) stands for the rest.
    """
    size = struct.calcsize("=" + FILE_HEADER)
    for order in "<>":
        if len(content) >= size:
            magic = struct.unpack_from(order + "I", content)[0]
            if magic in (MAGIC_MICRO, MAGIC_NANO):
                break
    else:
        raise ValueError("not a capture file")
    unit = 1 if magic == MAGIC_NANO else 1_000
    record = struct.Struct(order + RECORD_HEADER)
    at = size
    while at + record.size <= len(content):
        seconds, fraction, stored, _ = record.unpack_from(content, at)
        if at + record.size + stored > len(content):
            break
        at += record.size
        yield seconds * 1_000_000_000 + fraction * unit, bytes(content[at : at + stored])
        at += stored
    if at < len(content):
        if damaged != "mark":
            raise ValueError(f"damaged capture file: no whole record at byte {at} of {len(content)}")
        yield None, None


def _frame_batches(batches: Iterator[pa.RecordBatch], damaged: str) -> Iterator[pa.RecordBatch]:
    for files in batches:
        for path, content in zip(files["path"], files["content"], strict=True):
            records = enumerate(split_records(memoryview(content.as_buffer()), damaged))
            while rows := list(islice(records, FRAMES_AT_ONCE)):
                ns = pa.array([time for _, (time, _) in rows], pa.int64())
                micros = pa.array([None if time is None else time // 1_000 for _, (time, _) in rows], pa.int64())
                columns = [
                    pa.repeat(path, len(rows)),
                    pa.array([number for number, _ in rows], pa.int64()),
                    micros.cast(pa.timestamp("us", tz="UTC")),
                    ns,
                    pa.array([frame for _, (_, frame) in rows], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["path", "packet_no", "ts", "ts_ns", "frame"])


def frames_as_pandas(rows: list[tuple]) -> pd.DataFrame:
    table = pd.DataFrame(rows, columns=["path", "packet_no", "ts", "ts_ns", "frame"])
    return table.astype({"ts_ns": "Int64", "ts": "datetime64[us, UTC]"})


def split_frames(files: DataFrame, damaged: str = "fail") -> DataFrame:
    """Frames of whole capture files given as ``path`` and ``content``."""
    return files.select("path", "content").mapInArrow(
        lambda batches: _frame_batches(batches, damaged), FRAME_SCHEMA
    )


def number_frames(frames: DataFrame) -> DataFrame:
    """Frames of all files in one order: ``packet_no`` counts from 0 through all of them, ``file_no`` in the file.

    The order is that of time, then path, then place in the file. Everything that puts packets of a flow in
    order needs a number that no two packets share. Marks of unreadable rests have no time and no place and are left out.
    """
    whole = frames.where("frame IS NOT NULL").withColumnRenamed("packet_no", "file_no")
    ranked = global_rank(whole, ["ts_ns", "path", "file_no"])
    return ranked.withColumn("packet_no", F.col("rank") - 1).drop("rank")


def read_captures(
    spark: SparkSession, path: str, pattern: str = "*.pcap", *, damaged: str = "fail"
) -> DataFrame:
    """Frames of all capture files; ``packet_no`` counts from 0 inside each file (see ``number_frames``).

    A damaged file fails the read; with ``damaged`` "mark" a row with null ``frame`` stands for
    what could not be read of it, numbered like the record it begins with.

    ``ts`` holds microseconds, as Spark timestamps do; ``ts_ns`` keeps the full time.

    One task reads one file of less than the 2 GB a row can hold; ``split_captures`` reads larger ones in parts.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return split_frames(files, damaged)


class CaptureWriter(DataSourceArrowWriter):
    """Writes each task's rows to files of about ``roll_bytes``, visible only after the job has committed."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.nano = options.get("nano", "false").lower() == "true"
        self.order = ">" if options.get("byteorder", "little") == "big" else "<"
        self.roll_bytes = int(options.get("rollbytes", ROLL_BYTES))
        self.job = uuid.uuid4().hex
        system, folder = locate(self.path)
        held = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        if any(info.base_name.endswith(".pcap") for info in held):
            raise ValueError(f"{self.path} already holds capture files")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = locate(self.path)
        system.create_dir(folder, recursive=True)
        stem = f"_{self.job}-{context.partitionId():05d}-{context.taskAttemptId()}"
        magic, unit = (MAGIC_NANO, 1) if self.nano else (MAGIC_MICRO, 1_000)
        header = struct.pack(self.order + FILE_HEADER, magic, 2, 4, 0, 0, SNAPLEN, LINKTYPE_ETHERNET)
        record = struct.Struct(self.order + RECORD_HEADER)
        names: list[str] = []
        out, held = None, 0
        try:
            for batch in iterator:
                for ts_ns, frame in zip(batch["ts_ns"].to_pylist(), batch["frame"].to_pylist(), strict=True):
                    if out is None or held >= self.roll_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"{stem}-{len(names):05d}")
                        out, held = system.open_output_stream(f"{folder}/{names[-1]}"), len(header)
                        out.write(header)
                    seconds, rest = divmod(ts_ns, 1_000_000_000)
                    out.write(record.pack(seconds, rest // unit, len(frame), len(frame)) + frame)
                    held += record.size + len(frame)
        finally:
            if out is not None:
                out.close()
        return CaptureMessage(context.partitionId(), names)

    def commit(self, messages) -> None:
        system, folder = locate(self.path)
        for message in messages:
            for number, name in enumerate(message.names):
                # In order of their names: a dot is below a digit and that below an underscore.
                rolled = f"_{number:05d}" if number else ""
                system.move(f"{folder}/{name}", f"{folder}/part-{message.part:05d}{rolled}.pcap")

    def abort(self, messages) -> None:
        system, folder = locate(self.path)
        for message in messages:
            for name in message.names if message is not None else []:
                if system.get_file_info(f"{folder}/{name}").type == fs.FileType.File:
                    system.delete_file(f"{folder}/{name}")


class CaptureMessage(WriterCommitMessage):
    def __init__(self, part: int, names: list[str]):
        self.part, self.names = part, names


class CaptureDataSource(DataSource):
    """``df.write.format("capture")``; options path, nano, byteorder, rollbytes."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return "ts_ns long, frame binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return CaptureWriter(self.options, overwrite)


def write_captures(
    frames: DataFrame, path: str, *, nano: bool = False, byteorder: str = "little", files: int | None = None,
    roll_bytes: int = ROLL_BYTES,
) -> None:
    """Write ``frames(packet_no, ts_ns, frame)`` as capture files, one per task and ``roll_bytes``.

    Files follow each other in packet order; ``files`` sets how many tasks write them, about. ``path`` is a URI, or a
    folder that driver and executors share as a file system.
    """
    frames.sparkSession.dataSource.register(CaptureDataSource)
    key = F.col("packet_no")
    ranged = frames.repartitionByRange(files, key) if files else frames.repartitionByRange(key)
    ordered = ranged.sortWithinPartitions("packet_no")
    (
        ordered.select(F.col("ts_ns").cast("long").alias("ts_ns"), "frame")
        .write.format("capture")
        .option("nano", str(nano).lower())
        .option("byteorder", byteorder)
        .option("rollbytes", str(roll_bytes))
        .mode("append")
        .save(path)
    )
