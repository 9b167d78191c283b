import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bytesieve.operators import bloom, counts
from bytesieve.plans.inputs import frames, packets
from bytesieve.session import lookup_join, scratch_path, shared_root
from bytesieve.sources import capture, payloads, split_captures, tables


def test_shared_folder_comes_from_the_session(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti", "inner"])
def test_salted_join_equals_broadcast_join(spark, how):
    left = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(0, 40, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    rows = [
        sorted(map(tuple, lookup_join(left, right, ["k"], how, spread_by=F.col("id"), max_rows=size).select(
            "id", "k", *(["v"] if how in ("left", "inner") else [])).collect()), key=repr)
        for size in (100, 0)
    ]
    assert rows[0] == rows[1] and rows[0]


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti", "inner"])
def test_bytes_join_equals_plain_join(spark, how):
    rows = [(i, bytearray(bytes([i % 7, 0, 0][: 1 + i % 3]))) for i in range(200)]
    left = spark.createDataFrame(rows, "id long, gram binary")
    right = spark.createDataFrame([(bytearray(g), n) for n, g in enumerate([b"\x01", b"\x01\x00", b"\x05\x00\x00"])], "gram binary, v long")
    columns = ["id", "gram", *(["v"] if how in ("left", "inner") else [])]
    rows = [
        sorted(map(repr, joined.select(*columns).collect()))
        for joined in (lookup_join(left, right, ["gram"], how), left.join(right, "gram", how))
    ]
    assert rows[0] == rows[1] and rows[0]


def test_hex_lines_keep_reading_order(spark, tmp_path):
    lines = [f"{i:08x}" for i in range(5000)]
    (tmp_path / "b.txt").write_text("\n".join(lines[2500:]) + "\n")
    (tmp_path / "a.txt").write_text("\n".join(lines[:2500]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = payloads.hex_lines(spark, str(tmp_path), "gold")
        assert read.rdd.getNumPartitions() > 4
        rows = sorted(read.collect(), key=lambda r: tuple(r[c] for c in payloads.LINE_ORDER))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["payload_hex"] for r in rows] == lines and rows[0]["tier"] == "gold"


@pytest.mark.parametrize("keep_end", [False, True])
def test_raw_lines(spark, tmp_path, keep_end):
    data = [b"ab\x00c\r", b"\xff\xfe", b"", b"last"]
    (tmp_path / "x.bin").write_bytes(b"\n".join(data) + b"\n")
    got = [bytes(r["payload"]) for r in payloads.raw_lines(spark, str(tmp_path), keep_end=keep_end).collect()]
    assert got == [d + (b"\n" if keep_end else b"") for d in data]


def test_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,payload\n1,6162\n2,zz\n")
    df = counts.decoded(payloads.csv_payloads(spark, str(tmp_path)))
    assert [bytes(r["payload"]) for r in df.collect()] == [b"ab"]


def test_unused_files(spark, tmp_path):
    for name in "dacb":
        (tmp_path / f"{name}.txt").write_text("00\n")
    (tmp_path / "skip.log").write_text("00\n")
    names = payloads.file_names(spark, str(tmp_path))
    first = [r["name"][-5:] for r in payloads.unused_files(names, spark.createDataFrame([], "name string"), 3).collect()]
    assert first == ["a.txt", "b.txt", "c.txt"]
    used = names.where(F.col("name").rlike("[ab].txt$"))
    rest = [r["name"][-5:] for r in payloads.unused_files(names, used, 3).collect()]
    assert rest == ["c.txt", "d.txt"]


def pcap(records, order="<", nano=False, cut=0):
    magic = capture.MAGIC_NANO if nano else capture.MAGIC_MICRO
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for ns, frame in records:
        out += struct.pack(order + "IIII", ns // 10**9, ns % 10**9 // (1 if nano else 1000), len(frame), len(frame)) + frame
    return out[: len(out) - cut]


def test_capture_files_of_all_kinds(spark, tmp_path):
    rows = frames(spark, "/root/testdata/sf0.001").orderBy("packet_no").collect()
    records = [(r["ts_ns"], bytes(r["frame"])) for r in rows]
    quarter = len(records) // 4
    kinds = [("<", False), (">", False), ("<", True), (">", True)]
    for i, (order, nano) in enumerate(kinds):
        part = records[i * quarter : (i + 1) * quarter]
        (tmp_path / f"{i}.pcap").write_bytes(pcap(part, order, nano))
    got = capture.read_captures(spark, str(tmp_path)).orderBy("path", "packet_no").collect()
    assert [(r["ts_ns"], bytes(r["frame"])) for r in got] == records[: 4 * quarter]
    assert [r["packet_no"] for r in got] == list(range(quarter)) * 4
    assert [r["ts"] for r in got] == [r["ts"] for r in rows]


def test_truncated_and_foreign_files(spark, tmp_path):
    (tmp_path / "cut.pcap").write_bytes(pcap([(10**9, b"a" * 30), (2 * 10**9, b"b" * 30)], cut=5))
    with pytest.raises(PySparkException, match="damaged capture file"):
        capture.read_captures(spark, str(tmp_path)).collect()
    marked = capture.read_captures(spark, str(tmp_path), damaged="mark").orderBy("packet_no").collect()
    assert [r["frame"] and bytes(r["frame"]) for r in marked] == [b"a" * 30, None]
    (tmp_path / "foreign.pcap").write_bytes(b"not a capture file at all, really")
    # Foreign files fail either way.
    with pytest.raises(PySparkException, match="not a capture file"):
        capture.read_captures(spark, str(tmp_path), damaged="mark").collect()


@pytest.mark.parametrize("nano,order", [(False, "little"), (True, "big")])
def test_capture_round_trip(spark, tmp_path, nano, order):
    source = frames(spark, "/root/testdata/sf0.001").withColumn(
        "ts_ns", F.col("ts_ns") + (F.col("packet_no") % 1000 if nano else F.lit(0))
    )
    folder = str(tmp_path / "out")
    capture.write_captures(source, folder, nano=nano, byteorder=order)
    back = capture.read_captures(spark, folder).orderBy("path", "packet_no").collect()
    expected = source.orderBy("packet_no").collect()
    assert [(r["ts_ns"], r["frame"]) for r in back] == [(r["ts_ns"], r["frame"]) for r in expected]
    assert not [p for p in (tmp_path / "out").iterdir() if not p.name.endswith(".pcap")]


def both(rows):
    return [(r["path"], r["packet_no"], r["ts_ns"], r["frame"]) for r in rows]


@pytest.mark.parametrize("split,count", [(100, 4), (700, 40), (5_000, 60)])
def test_split_files_equal_whole_ones(spark, tmp_path, split, count):
    """Small and large records, payloads full of bytes that look like records, several orders and units."""
    import random

    rng = random.Random(split)
    second = 1_700_000_000
    for i, (order, nano) in enumerate([("<", False), (">", True), ("<", True)]):
        records = []
        for n in range(count):
            fake = struct.pack(order + "IIII", second + n, 5, 8, 8) + b"realistic"[:8]
            frame = rng.choice([b"", rng.randbytes(rng.randrange(90)), fake * rng.randrange(1, 30), b"\0" * 400])
            records.append(((second + n) * 10**9 + 1000 * n, frame))
        (tmp_path / f"{i}.pcap").write_bytes(pcap(records, order, nano))
    (tmp_path / "none.pcap").write_bytes(pcap([]))
    whole = capture.read_captures(spark, str(tmp_path)).orderBy("path", "packet_no").collect()
    parts = split_captures.read_split_captures(spark, str(tmp_path), split_bytes=split)
    assert both(parts.orderBy("path", "packet_no").collect()) == both(whole) and whole


def test_split_damaged_files(spark, tmp_path):
    records = [(10**9 * n, bytes([n]) * 50) for n in range(1, 40)]
    (tmp_path / "cut.pcap").write_bytes(pcap(records, cut=20))
    (tmp_path / "good.pcap").write_bytes(pcap(records))
    for split in (500, 1 << 20):
        with pytest.raises(PySparkException, match="damaged capture file"):
            split_captures.read_split_captures(spark, str(tmp_path), split_bytes=split).collect()
        whole = capture.read_captures(spark, str(tmp_path), damaged="mark").orderBy("path", "packet_no").collect()
        marked = split_captures.read_split_captures(spark, str(tmp_path), split_bytes=split, damaged="mark")
        assert both(marked.orderBy("path", "packet_no").collect()) == both(whole)
    (tmp_path / "foreign.pcap").write_bytes(b"not a capture file at all, really")
    with pytest.raises(PySparkException, match="not a capture file"):
        split_captures.read_split_captures(spark, str(tmp_path), split_bytes=700, damaged="mark").collect()


def test_captures_are_written_through_uris(spark, tmp_path):
    source = frames(spark, "/root/testdata/sf0.001")
    capture.write_captures(source, f"file://{tmp_path}/out", files=2)
    assert capture.read_captures(spark, str(tmp_path / "out")).count() == source.count()


def test_large_captures_are_rolled_in_packet_order(spark, tmp_path):
    """A task's file is bounded however many frames the task has, and names still follow the packets."""
    source = frames(spark, "/root/testdata/sf0.001")
    capture.write_captures(source, str(tmp_path / "out"), files=1, roll_bytes=2_000)
    sizes = [p.stat().st_size for p in (tmp_path / "out").iterdir()]
    assert len(sizes) > 3 and max(sizes) < 2_000 + 2_000
    back = capture.read_captures(spark, str(tmp_path / "out")).orderBy("path", "packet_no").collect()
    assert [(r["ts_ns"], r["frame"]) for r in back] == [
        (r["ts_ns"], r["frame"]) for r in source.orderBy("packet_no").collect()
    ]


def test_failed_capture_write_leaves_no_file(spark, tmp_path):
    folder = str(tmp_path / "out")
    bad = packets(spark, "/root/testdata/sf0.001").select(
        "packet_no", F.lit(-5).cast("long").alias("ts_ns"), F.col("payload").alias("frame")
    )
    with pytest.raises(PySparkException):
        capture.write_captures(bad, folder)
    assert [p.name for p in (tmp_path / "out").glob("*.pcap")] == []


def test_saved_counts_have_versions(spark):
    path = scratch_path(spark, "t")
    table = spark.createDataFrame([("gold", bytearray(b"ab"), 2), ("bad", bytearray(b"cd"), 3)], "tier string, gram binary, cnt long")
    with pytest.raises(FileNotFoundError):
        tables.load_counts(spark, path)
    assert tables.save_counts(table, path) == 1
    loaded = tables.load_counts(spark, path)
    assert tables.save_counts(counts.merge_counts(loaded, table, by=("tier",)), path) == 2
    assert {(r["tier"], r["cnt"]) for r in tables.load_counts(spark, path).collect()} == {("gold", 4), ("bad", 6)}


def test_unreadable_filter_generation_is_skipped(spark, tmp_path):
    vocab = spark.range(300).select(
        F.lit("gold").alias("tier"), (F.col("id") % 3).cast("int").alias("generation"),
        F.unhex(F.lpad(F.hex("id"), 10, "0")).alias("gram"),
    )
    bits = bloom.bits_for(1000, 4)
    path = str(tmp_path / "filters")
    with pytest.raises(FileNotFoundError):
        tables.load_filters(spark, path)
    tables.save_filters(bloom.build_bloom(vocab, 4, bits, by=("tier", "generation")), bloom.bloom_meta(vocab, 1000, 4), path)
    bitmaps, meta, skipped = tables.load_filters(spark, path)
    assert meta.count() == 3 and skipped.count() == 0
    for file in (tmp_path / "filters").glob("version-1/bitmaps/tier=gold/generation=1/part-*"):
        file.write_bytes(b"garbage")
    for crc in (tmp_path / "filters").glob("version-1/bitmaps/tier=gold/generation=1/.part-*.crc"):
        crc.unlink()
    bitmaps, meta, skipped = tables.load_filters(spark, path)
    assert sorted(r["generation"] for r in meta.collect()) == [0, 2]
    assert [r["generation"] for r in skipped.collect()] == [1]
    assert sorted({r["generation"] for r in bitmaps.collect()}) == [0, 2]


def test_packets_of_one_flow_in_several_capture_files(spark, tmp_path):
    """Two files whose packets have equal numbers: numbered through both, the flow's bytes are in order."""
    from bytesieve.operators.flows import flow_buffers

    def record(second, payload):
        return struct.pack("<IIII", second, 0, len(payload), len(payload)) + payload

    header = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, 1)
    (tmp_path / "b.pcap").write_bytes(header + record(1, b"AAAA") + record(2, b"BBBB"))
    (tmp_path / "a.pcap").write_bytes(header + record(3, b"CCCC") + record(3, b"DDDD"))
    numbered = capture.number_frames(capture.read_captures(spark, str(tmp_path)))
    packets = numbered.selectExpr("packet_no", "'s' AS src", "'d' AS dst", "1 AS sport", "2 AS dport", "frame AS payload")
    assert [bytes(r["buffer"]) for r in flow_buffers(packets).collect()] == [b"AAAABBBBCCCCDDDD"]
    assert sorted((r["packet_no"], r["file_no"]) for r in numbered.collect()) == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_damaged_captures_fail_or_are_marked(spark, tmp_path):
    header = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, 1)
    good = struct.pack("<IIII", 1, 0, 2, 2) + b"ok"
    (tmp_path / "x.pcap").write_bytes(header + good + good + struct.pack("<IIII", 1, 0, 999, 999) + b"rest")
    with pytest.raises(Exception, match="damaged capture file"):
        capture.read_captures(spark, str(tmp_path)).collect()
    rows = capture.read_captures(spark, str(tmp_path), damaged="mark").orderBy("packet_no").collect()
    assert [(r["packet_no"], r["frame"] is None, r["ts_ns"]) for r in rows] == [
        (0, False, 10**9), (1, False, 10**9), (2, True, None),
    ]
