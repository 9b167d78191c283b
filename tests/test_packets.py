import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from bytesieve.functions.headers import (
    only_protocol,
    parse_frames,
    rewrite_ports,
    tcp_flag_letters,
    tcp_port,
)
from bytesieve.functions.http import MessageCutter, message_heads
from bytesieve.operators import flows


def ip_frame(proto, l4, *, options=b"", ethertype=0x0800, total=None, fragment=0, pad=True):
    length = 20 + len(options) + len(l4) if total is None else total
    head = struct.pack(
        ">BBHHHBBH4s4s", 0x40 | (5 + len(options) // 4), 0, length, 1, fragment, 64, proto, 0,
        bytes([10, 0, 1, 255]), bytes([192, 168, 0, 7]),
    )
    frame = b"\x02" * 12 + struct.pack(">H", ethertype) + head + options + l4
    return frame.ljust(60, b"\0") if pad else frame


def tcp(sport, dport, payload=b"", flags=0x18, options=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, 1, 2, (5 + len(options) // 4) << 4, flags, 512, 0, 0) + options + payload


def udp(sport, dport, payload=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


FRAMES = [
    ip_frame(6, tcp(80, 1024, b"hi")),
    ip_frame(6, tcp(22, 80, b"opt", options=b"\1" * 12), options=b"\0" * 8),
    ip_frame(17, udp(53, 65535, b"\x00\xff")),
    ip_frame(6, tcp(5, 6, b"x" * 100)),
    ip_frame(6, tcp(5, 6), total=0),
    ip_frame(6, tcp(5, 6, b"v6"), ethertype=0x86DD),
    ip_frame(6, tcp(5, 6, b"frag"), fragment=185),
    ip_frame(6, tcp(5, 6)[:12], pad=False),
    b"\x02" * 10,
    b"",
    ip_frame(1, b"\x08\x00echo"),
]


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(i, bytearray(f)) for i, f in enumerate(FRAMES)]
    return spark.createDataFrame(rows, "packet_no long, frame binary")


def test_headers(frames):
    got = {r["packet_no"]: r for r in parse_frames(frames).collect()}
    assert len(got) == len(FRAMES)

    def fields(i):
        r = got[i]
        return r["proto"], r["src"], r["dst"], r["sport"], r["dport"], r["flags"], r["payload"] and bytes(r["payload"])

    a, b = "10.0.1.255", "192.168.0.7"
    assert fields(0) == (6, a, b, 80, 1024, 0x18, b"hi")
    assert fields(1) == (6, a, b, 22, 80, 0x18, b"opt")
    assert fields(2) == (17, a, b, 53, 65535, 0, b"\x00\xff")
    assert fields(3) == (6, a, b, 5, 6, 0x18, b"x" * 100)
    # Total length 0 means the rest of the frame, padding included.
    assert fields(4)[:5] == (6, a, b, 5, 6) and fields(4)[6] == b"\0" * 6
    assert got[5]["ethertype"] == 0x86DD and fields(5) == (None,) * 7
    assert fields(6) == (6, a, b, None, None, None, None)
    assert fields(7) == (6, a, b, None, None, None, None)
    assert got[8]["ethertype"] is None and got[9]["ethertype"] is None
    assert fields(10) == (1, a, b, None, None, None, None)


def test_protocol_and_port_filters(frames):
    parsed = parse_frames(frames)
    ids = lambda df: sorted(r["packet_no"] for r in df.collect())
    assert ids(only_protocol(parsed, 6)) == [0, 1, 3, 4]
    assert ids(only_protocol(parsed, 17)) == [2]
    assert ids(tcp_port(parsed)) == [0, 1]


def test_flag_letters(spark):
    df = spark.createDataFrame([(18,), (0,), (255,), (1,)], "flags int")
    assert [r[0] for r in df.select(tcp_flag_letters(F.col("flags"))).collect()] == ["SA", "", "FSRPAUEC", "F"]


def test_port_rewrite(spark, frames):
    mapping = spark.createDataFrame([(22, 5022), (80, 8080)], "from_port int, to_port int")
    got = {r["packet_no"]: bytes(r["frame"]) for r in rewrite_ports(frames, mapping).collect()}
    expected = dict(enumerate(FRAMES))
    expected[0] = ip_frame(6, tcp(8080, 1024, b"hi"))
    expected[1] = ip_frame(6, tcp(5022, 8080, b"opt", options=b"\1" * 12), options=b"\0" * 8)
    assert got == expected


def test_message_heads(spark):
    data = [
        b"GET /a?b HTTP/1.1\r\nHost: h\r\n\r\nrest",
        b"POST /p HTTP/1.1\r\ncontent-length: 5\r\n\r\nabc",
        b"HTTP/1.1 404 Not Found\r\nX: y\r\n\r\n",
        b"HTTP/1.1 200 OK\r\nX: y\r\n",
        b"\xff\xfebinary\r\n\r\n",
        b"",
        b"FETCH / HTTP/1.1\r\n\r\n",
    ]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, d binary")
    got = {r["i"]: r.asDict() for r in message_heads(df, "d", ("i",)).collect()}
    assert set(got) == {0, 1, 2}
    assert (got[0]["kind"], got[0]["method"], got[0]["uri"], got[0]["complete"]) == ("request", "GET", "/a?b", True)
    assert got[0]["head_bytes"] == len(data[0]) - 4
    assert (got[1]["method"], got[1]["body_bytes"], got[1]["complete"]) == ("POST", 5, False)
    assert (got[2]["kind"], got[2]["status"], got[2]["method"]) == ("response", 404, None)


def test_cutter_gives_the_same_messages_for_any_cut():
    stream = (
        b"GET /1 HTTP/1.1\r\nHost: h\r\n\r\n"
        b"POST /2 HTTP/1.1\r\nContent-Length: 7\r\n\r\nabc\r\n\r\n"
        b"HTTP/1.1 200 OK\r\nContent-Length: 0\r\n\r\n"
        b"PUT /3 HTTP/1.1\r\nContent-Length: 2\r\n\r\nxy"
    )
    expected = [("request", "GET", "/1"), ("request", "POST", "/2"), ("response", None, None), ("request", "PUT", "/3")]
    rng = random.Random(17)
    for size in [1, 2, 5, 1000] + [rng.randrange(1, 60) for _ in range(20)]:
        state, found = None, []
        for at in range(0, len(stream), size):
            cutter = MessageCutter(state)
            found += cutter.feed(stream[at : at + size])
            state = cutter.state()
        assert [m[:3] for m in found] == expected
        assert sum(m[4] for m in found) == len(stream)


@pytest.mark.parametrize("data", [b'{"k": 1}', b"GETX / HTTP/1.1\r\n\r\n", b"GET\r\n\r\n", b"HTTP/1.1 abc\r\n\r\n"])
def test_cutter_counts_the_bytes_of_foreign_flows(data):
    cutter = MessageCutter()
    assert cutter.feed(data) == [("foreign", None, None, None, len(data))] and cutter.foreign and not cutter.line
    assert cutter.feed(b"GET / HTTP/1.1\r\n\r\n") == [("foreign", None, None, None, 18)]


OK = b"HTTP/1.1 200 OK\r\n"
# (method asked, its reply)
REPLIES = [
    ("GET", OK + b"Content-Length: 3\r\n\r\nabc"),
    ("HEAD", OK + b"Content-Length: 3\r\n\r\n"),
    ("GET", b"HTTP/1.1 304 Not Modified\r\nContent-Length: 10\r\n\r\n"),
    ("GET", b"HTTP/1.1 204 No Content\r\ncontent-length: 9\r\n\r\n"),
    ("GET", OK + b"Transfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0b;x=1\r\nhello world\r\n0\r\nT: 1\r\n\r\n"),
    ("GET", OK + b"Transfer-Encoding: gzip, chunked\r\nContent-Length: 2\r\n\r\n0\r\n\r\n"),
    ("GET", b"\r\n\r\n" + OK + b"\r\n"),
    ("GET", OK + b"X: " + b"y" * 5000 + b"\r\nContent-Length: 1\r\n\r\nz"),
]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 20])
def test_replies_end_where_their_request_and_head_say(size):
    """Every reply, followed by all the others and by a plain one, cut into packets of any size."""
    replies = [REPLIES[i] for i in (0, 1, 2, 3, 4, 5, 6, 7, 2, 1, 4, 0)]
    asked = [method for method, _ in replies]
    cutter, found = MessageCutter(None, asked), []
    stream = b"".join(reply for _, reply in replies)
    for at in range(0, len(stream), size):
        found += cutter.feed(stream[at : at + size])
        cutter = MessageCutter(cutter.state(), asked)
    assert [m[4] for m in found] == [len(reply.lstrip(b"\r\n")) for _, reply in replies] and {m[0] for m in found} == {"response"}
    assert not asked and cutter.unfinished() == 0


def test_interim_replies_and_tunnels():
    asked = ["POST", "CONNECT"]
    cutter = MessageCutter(None, asked)
    assert [m[3] for m in cutter.feed(b"HTTP/1.1 100 Continue\r\n\r\n" + OK + b"Content-Length: 1\r\n\r\nx")] == [100, 200]
    assert asked == ["CONNECT"]
    found = cutter.feed(OK + b"\r\n\x16\x03tls")
    assert [m[0] for m in found] == ["response", "foreign"] and found[1][4] == 5


def test_long_heads_take_time_in_proportion():
    head = b"GET / HTTP/1.1\r\n" + b"".join(b"X-%d: %s\r\n" % (i, b"v" * 90) for i in range(12_000)) + b"\r\n"
    cutter, found, began, kept = MessageCutter(), [], time.perf_counter(), 0
    for at in range(0, len(head), 60):
        found += cutter.feed(head[at : at + 60])
        cutter = MessageCutter(cutter.state())
        kept = max(kept, len(cutter.line))
    assert [m[4] for m in found] == [len(head)] and kept <= cutter.LINE_KEPT
    assert time.perf_counter() - began < 3


def test_first_lines_without_end_are_foreign():
    cutter = MessageCutter()
    lost = sum(m[4] for _ in range(30) for m in cutter.feed((b"GET /" if _ == 0 else b"") + b"a" * 100_000))
    assert cutter.foreign and lost == 3_000_005


PACKETS = "packet_no long, proto int, src string, dst string, sport int, dport int, payload binary"


@pytest.fixture(scope="module")
def many_packets(spark):
    rng = random.Random(23)
    rows = []
    for i in range(3000):
        user = 0 if rng.random() < 0.5 else rng.randrange(1, 12)
        ends = [("10.0.0.%d" % user, 1000 + user), ("192.168.0.1", 80)]
        (src, sport), (dst, dport) = ends if rng.random() < 0.6 else ends[::-1]
        payload = rng.randbytes(rng.choice([0, 1, 3, 40, 200])) if user != 11 else b""
        rows.append((i, 17 if user == 10 else 6, src, dst, sport, dport, bytearray(payload)))
    return rows, spark.createDataFrame(rows, PACKETS).repartition(7)


@pytest.mark.parametrize("chunk", [1 << 20, 100])
def test_reassembly(many_packets, chunk):
    rows, df = many_packets
    expected = {}
    for r in rows:
        expected[r[2:6]] = expected.get(r[2:6], b"") + bytes(r[6])
    got = {}
    for r in flows.flow_buffers(df, chunk).orderBy("chunk_no").collect():
        key = (r["src"], r["dst"], r["sport"], r["dport"])
        assert len(got.get(key, b"")) == r["chunk_no"] * chunk and len(r["buffer"]) <= chunk
        got[key] = got.get(key, b"") + bytes(r["buffer"])
    assert got == {key: data for key, data in expected.items() if data}
    empty = {(r["src"], r["dst"], r["sport"], r["dport"]) for r in flows.empty_flows(df).collect()}
    assert empty == {key for key, data in expected.items() if not data} and empty


def test_stream_ids(many_packets):
    rows, df = many_packets
    expected, ids = {}, {}
    for r in rows:
        if r[1] == 6:
            key = tuple(sorted([(r[2], r[4]), (r[3], r[5])]))
            expected[r[0]] = ids.setdefault(key, len(ids))
    streamed = flows.with_stream_id(df)
    assert {r["packet_no"]: r["stream_id"] for r in streamed.collect()} == expected
    assert [r[0] for r in flows.stream_ids(streamed).collect()] == list(range(len(ids)))


def test_excluded_flows(spark, many_packets):
    rows, df = many_packets
    listed = {r[2:6] for r in rows[:2]}
    table = spark.createDataFrame([*listed, *listed], "src string, dst string, sport int, dport int")
    got = {r["packet_no"] for r in flows.exclude_flows(df, table).collect()}
    assert got == {r[0] for r in rows if r[2:6] not in listed}


def test_long_streams_are_written_by_several_tasks(spark, many_packets, tmp_path):
    rows, df = many_packets
    streamed = flows.with_stream_id(df)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = flows.by_stream_tasks(streamed, packets_per_task=100)
        tasks = placed.select("stream_id", F.spark_partition_id().alias("task")).distinct()
        assert max(r["count"] for r in tasks.groupBy("stream_id").count().collect()) > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    path = str(tmp_path / "streams")
    flows.write_streams(streamed.select("stream_id", "packet_no"), path)
    back = {r["packet_no"]: r["stream_id"] for r in spark.read.parquet(path).collect()}
    assert back == {r["packet_no"]: r["stream_id"] for r in streamed.collect()}
    assert len(back) == sum(r[1] == 6 for r in rows)


def test_many_streams_share_folders_and_are_read_one_by_one(spark, tmp_path):
    """As many folders as ranges of streams need, and one stream still comes from its folder alone."""
    rows = [(packet, packet % 250) for packet in range(1_000)]
    path = str(tmp_path / "streams")
    flows.write_streams(spark.createDataFrame(rows, "packet_no long, stream_id long"), path, streams_per_folder=100)
    assert sorted(p.name for p in (tmp_path / "streams").glob("streams=*")) == ["streams=0", "streams=1", "streams=2"]
    for stream in (0, 99, 100, 249):
        read = flows.read_stream(spark, path, stream, "packet_no long, stream_id long", streams_per_folder=100)
        assert "streams#" in read._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
        assert [r["packet_no"] for r in read.orderBy("packet_no").collect()] == list(range(stream, 1_000, 250))


def test_heads_do_not_depend_on_chunk_size(spark):
    long_head = b"GET /" + b"a" * 200 + b" HTTP/1.1\r\nHost: h\r\n\r\nbody"
    payloads = {
        1: [long_head[:70], long_head[70:]], 2: [b"HTTP/1.1 200 OK\r\n\r", b"\n"], 3: [b"GET / HTTP/1.1\r\nHost: h"],
        4: [b"\x00\x01 GET / HTTP/1.1\r\n\r\n"], 5: [b"PUT /x HTTP/1.1\r\n\r\n" + b"z" * 99],
    }
    rows = [
        (10 * port + i, 6, "a", "b", port, 80, bytearray(part))
        for port, parts in payloads.items()
        for i, part in enumerate(parts)
    ]
    df = spark.createDataFrame(rows, PACKETS)
    results = [
        sorted(tuple(r) for r in flows.first_messages(flows.flow_buffers(df, chunk_bytes=size)).collect())
        for size in (3, 16, 64, 1 << 20)
    ]
    assert all(result == results[0] for result in results)
    assert [(r[2], r[4]) for r in results[0]] == [(1, "request"), (2, "response"), (5, "request")]


def test_equal_packet_numbers_in_a_flow_are_refused(spark):
    rows = [(0, 6, "a", "b", 1, 2, bytearray(b"A")), (0, 6, "a", "b", 1, 2, bytearray(b"B"))]
    with pytest.raises(ValueError, match="packet_no repeats"):
        flows.flow_buffers(spark.createDataFrame(rows, PACKETS))


@pytest.mark.parametrize(
    "message, kind",
    [
        (b"HTTP/2.0 200 OK\r\n\r\n", "response"), (b"GET /a HTTP/1.1\r\n\r\n", "request"), (b" GET /a HTTP/1.1\r\n\r\n", None),
        (b"HTTP/1.1 20 OK\r\n\r\n", None), (b"HTTPS nonsense\r\n\r\n", None), (b"VERSION-CONTROL /v\r\n\r\n", "request"),
        (b"PUT /p HTTP/1.1\r\nContent-Length: 3\r\nContent-Length: 9\r\n\r\nabc", "request"),
    ],
)
def test_one_grammar_for_buffers_and_streams_cut_anywhere(spark, message, kind):
    from bytesieve.functions.http import MessageCutter, message_heads

    heads = message_heads(spark.createDataFrame([(bytearray(message),)], "buffer binary"), "buffer").collect()
    assert [r["kind"] for r in heads] == ([kind] if kind else [])
    for cut in range(1, len(message)):
        cutter = MessageCutter()
        found = cutter.feed(message[:cut])
        cutter = MessageCutter(cutter.state())
        found += cutter.feed(message[cut:])
        assert [m[0] for m in found if m[0] != "foreign"] == ([kind] if kind else []), cut
        # Whatever is no message is counted.
        assert sum(m[4] for m in found) == len(message)


def test_buffers_stay_empty_until_the_first_payload(spark):
    rows = [
        ("a", "b", 1, 2, 0, b""), ("a", "b", 1, 2, 3, None), ("a", "b", 1, 2, 5, b"x"), ("a", "b", 1, 2, 7, b""),
        ("b", "a", 2, 1, 4, b""), ("c", "a", 2, 1, 6, b"y"),
    ]
    packets = spark.createDataFrame(rows, "src string, dst string, sport int, dport int, packet_no long, payload binary")
    assert sorted(r["packet_no"] for r in flows.empty_buffers(packets).collect()) == [0, 3, 4]
