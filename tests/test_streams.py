import os
import random
import time
from collections import Counter

from helpers import gram_dict
from pyspark.sql import functions as F

from bytesieve.operators.flows import MESSAGE_SCHEMA, all_messages
from bytesieve.streaming import ingest, packets


def brute(payloads, n):
    return Counter(p[i : i + n] for p in payloads for i in range(len(p) - n + 1))


def write_lines(folder, name, payloads, extra=()):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(p.hex() + "\n" for p in payloads) + "".join(x + "\n" for x in extra))


def test_counts_over_several_runs(spark, tmp_path):
    rng = random.Random(31)
    payloads = [bytes(rng.choices(b"abcd", k=30)) for _ in range(50)]
    folder, deltas = tmp_path / "in", str(tmp_path / "deltas")
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    for i in range(3):
        write_lines(folder, f"{i}.txt", payloads[i * 10 : i * 10 + 10], ["zz", "abc"])
    ingest.ingest_counts(spark, str(folder), deltas, state, 4, files_per_batch=2)
    assert gram_dict(ingest.compact_counts(spark, deltas, table)) == brute(payloads[:30], 4)
    # Nothing new: the same table, compacted again without adding anything twice.
    ingest.ingest_counts(spark, str(folder), deltas, state, 4)
    assert gram_dict(ingest.compact_counts(spark, deltas, table)) == brute(payloads[:30], 4)
    write_lines(folder, "3.txt", payloads[30:])
    ingest.ingest_counts(spark, str(folder), deltas, state, 4)
    assert gram_dict(ingest.compact_counts(spark, deltas, table)) == brute(payloads, 4)


def test_replayed_batch_replaces_itself(spark, tmp_path):
    write = ingest._write_delta(str(tmp_path / "d"))
    rows = spark.createDataFrame([(bytearray(b"ab"), 2)], "gram binary, cnt long")
    write(rows, 0)
    write(rows, 0)
    write(rows, 1)
    assert sorted(r["batch_id"] for r in ingest.read_deltas(spark, str(tmp_path / "d")).collect()) == [0, 1]


def test_used_files_are_archived(spark, tmp_path):
    folder, used = tmp_path / "in", tmp_path / "used"
    deltas, state = str(tmp_path / "deltas"), str(tmp_path / "state")
    for run in range(3):
        write_lines(folder, f"{run}.txt", [b"abcdef"])
        ingest.ingest_counts(spark, str(folder), deltas, state, 5, archive=str(used))
    assert gram_dict(ingest.compact_counts(spark, deltas, str(tmp_path / "t"))) == {b"abcde": 3, b"bcdef": 3}
    archived = sorted(p.name for p in used.rglob("*.txt"))
    assert archived[:1] == ["0.txt"]


def test_second_sightings_across_runs(spark, tmp_path):
    rng = random.Random(37)
    payloads = [bytes(rng.choices(b"abcdefgh", k=20)) for _ in range(30)]
    folder, deltas, state = tmp_path / "in", str(tmp_path / "deltas"), str(tmp_path / "state")
    for run in range(3):
        write_lines(folder, f"{run}.txt", payloads[run * 10 : run * 10 + 10])
        ingest.ingest_second_sightings(spark, str(folder), deltas, state, 3)
    expected = {g: c for g, c in brute(payloads, 3).items() if c >= 2}
    assert gram_dict(ingest.second_sighting_vocabulary(spark, deltas)) == expected


def test_live_counters(spark, tmp_path):
    from bytesieve.functions.codec import hex_decode

    write_lines(tmp_path / "in", "0.txt", [b"abcdef", b"ab"], ["zz", "123"])
    stream = ingest.payload_stream(spark, str(tmp_path / "in")).withColumn("payload", hex_decode(F.col("payload_hex")))
    run = ingest.run_batches(
        ingest.observe_training(stream, 5), str(tmp_path / "state"), lambda batch, _: batch.write.format("noop").mode("append").save()
    )
    totals = ingest.observed_totals(run)
    assert [{k: v for k, v in t.items() if k != "batch_id"} for t in totals] == [
        {"payloads": 4, "undecodable": 2, "too_short": 1, "ngrams": 2}
    ]


PACKETS = "packet_no long, ts timestamp, src string, dst string, sport int, dport int, payload binary"
GET = b"GET /%d HTTP/1.1\r\nHost: h\r\n\r\n"


def run_messages(spark, tmp_path, batches, **options):
    """Feed each batch of (packet_no, second, client, payload[, path]) as one file and one trigger."""
    session = ingest.state_session(spark)
    folder, out = str(tmp_path / "packets"), str(tmp_path / "messages")
    schema = PACKETS + ", path string" * (len(batches[0][0]) > 4)
    for rows in batches:
        # A negative client is the reply to a client.
        table = []
        for n, second, client, payload, *path in rows:
            ends = [(f"10.0.0.{abs(client)}", 1000), ("10.9.9.9", 80)][:: 1 if client > 0 else -1]
            table.append((n, second, ends[0][0], ends[1][0], ends[0][1], ends[1][1], bytearray(payload), *path))
        df = spark.createDataFrame(table, schema.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
        df.coalesce(1).write.mode("append").parquet(folder)
        stream = session.readStream.schema(schema).parquet(folder)
        query = (
            packets.flow_messages(stream, **options)
            .writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True)
            .start(out)
        )
        query.awaitTermination()
    found = spark.read.schema(MESSAGE_SCHEMA).parquet(out).collect()
    return sorted((r["src"][-1], r["packet_no"], r["kind"], r["uri"] or r["status"] or r["message_bytes"]) for r in found)


def test_messages_across_batches(spark, tmp_path):
    second = GET % 2
    batches = [
        [(1, 100, 1, GET % 1 + second[:10]), (0, 100, 2, b'{"k": 1}')],
        [(3, 105, 1, second[20:]), (2, 104, 1, second[10:20])],
        [(4, 106, 2, GET % 9), (5, 106, 1, GET % 3)],
    ]
    assert run_messages(spark, tmp_path, batches) == [
        ("1", 1, "request", "/1"),
        ("1", 3, "request", "/2"),
        ("1", 5, "request", "/3"),
        ("2", 0, "foreign", 8),
        ("2", 4, "foreign", len(GET % 9)),
    ]


def test_packets_of_several_files_have_one_order(spark, tmp_path):
    """Numbers start anew in every file; time, then path, then number put the packets in order."""
    one, two = GET % 1, GET % 2
    batches = [
        [(0, 107, 1, two[5:], "b.pcap"), (0, 100, 1, one[:9], "a.pcap"), (1, 100, 1, one[9:], "a.pcap"), (1, 106, 1, two[:5], "a2.pcap")],
        [(0, 200, 1, GET % 3, "c.pcap"), (5, 107, 1, b"too late", "a.pcap"), (0, 300, 2, GET % 4, "c.pcap")],
    ]
    assert run_messages(spark, tmp_path, batches) == [
        ("1", 0, "request", "/2"),
        ("1", 0, "request", "/3"),
        ("1", 1, "request", "/1"),
        ("1", 5, "late", 8),
        ("2", 0, "request", "/4"),
    ]


def test_replies_know_their_request(spark, tmp_path):
    head = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n"
    batches = [
        [(0, 1, 1, b"HEAD /a HTTP/1.1\r\n\r\n"), (1, 1, 1, GET % 7)],
        [(2, 2, -1, head), (3, 3, -1, head + b"he")],
        [(4, 4, -1, b"llo"), (5, 5, 1, GET % 8)],
    ]
    assert run_messages(spark, tmp_path, batches) == [
        ("1", 0, "request", "/a"),
        ("1", 1, "request", "/7"),
        ("1", 5, "request", "/8"),
        ("9", 2, "response", 200),
        ("9", 4, "response", 200),
    ]


def test_idle_flow_is_freed_and_no_byte_is_lost(spark, tmp_path):
    half = GET % 1
    batches = [
        [(0, 1000, 1, half[:12])],
        [(1, 9000, 2, GET % 5)],
        [(2, 9100, 1, half[12:])],
        [(1, 10, 1, GET % 6)],
    ]
    assert run_messages(spark, tmp_path, batches, idle_seconds=600) == [
        # The first flow paused past its limit, so its second half starts anew and is foreign.
        ("1", 0, "freed", 12),
        ("1", 1, "late", len(GET % 6)),
        ("1", 2, "foreign", len(half) - 12),
        ("2", 1, "request", "/5"),
    ]


def test_batch_equals_plain_cutting_for_packets_of_any_size(spark):
    """Conversations in both directions, cut into packets of several sizes, over files numbered from 0."""
    import random

    rng = random.Random(4)
    reply = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"5\r\nhello\r\n" * 9 + b"0\r\n\r\n"
    for size in (16, 64, 1 << 20):
        rows, number = [], 0
        expected = set()
        for client in range(1, 6):
            for i in range(6):
                body = b"x" * rng.randrange(300)
                post = b"POST /%d HTTP/1.1\r\nContent-Length: %d\r\n\r\n" % (i, len(body)) + body
                expected |= {(client, "request", f"/{i}", len(post)), (client, "response", i, len(reply))}
                for data, ends in ((post, 1), (reply, -1)):
                    for at in range(0, len(data), size):
                        pair = [(f"10.0.0.{client}", 1000), ("10.9.9.9", 80)][::ends]
                        flow = (pair[0][0], pair[1][0], pair[0][1], pair[1][1])
                        rows.append((number % 7, 1000 + number, f"{number // 7:05d}.pcap", *flow, bytearray(data[at : at + size])))
                        number += 1
            rows.append((number % 7, 1000 + number, f"{number // 7:05d}.pcap", f"10.0.0.{client}", "10.9.9.9", 1000, 80, bytearray(b"GET /left")))
            number += 1
        schema = "packet_no long, ts long, path string, src string, dst string, sport int, dport int, payload binary"
        rng.shuffle(rows)
        table = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("ts"))
        found = all_messages(table.repartition(5)).collect()
        unfinished = [r for r in found if r["kind"] == "unfinished"]
        assert len(unfinished) == 5 and {r["message_bytes"] for r in unfinished} == {9}
        whole = [r for r in found if r["kind"] != "unfinished"]
        requests = {(int(r["src"][-1]), "request", r["uri"], r["message_bytes"]) for r in whole if r["kind"] == "request"}
        assert requests == {e for e in expected if e[1] == "request"} and len(whole) == 60
        assert {r["message_bytes"] for r in whole if r["kind"] == "response"} == {len(reply)}


def test_state_is_left_after_processing_time(spark, tmp_path):
    batches = [[(0, 1000, 1, GET[:12])], [(1, 1001, 2, GET % 5)]]
    found = run_messages(spark, tmp_path, batches, keep_seconds=0.001)
    assert found == [("1", 0, "freed", 12), ("2", 1, "request", "/5")]


def test_capture_stream_equals_batch(spark, tmp_path):
    from bytesieve.functions.headers import parse_frames, tcp_port
    from bytesieve.plans.inputs import frames
    from bytesieve.sources.capture import write_captures

    source = frames(spark, "/root/testdata/sf0.001")
    folder, out = str(tmp_path / "captures"), str(tmp_path / "out")
    write_captures(source, folder)
    stream = packets.port_stream(packets.frame_stream(spark, folder, files_per_batch=3))
    for _ in range(2):
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(
            availableNow=True
        ).start(out).awaitTermination()
    got = sorted(r["frame_hex"] for r in spark.read.schema("ts timestamp, frame_hex string").parquet(out).collect())
    batch = tcp_port(parse_frames(source.withColumn("data", F.col("frame"))))
    assert got == sorted(bytes(r["data"]).hex() for r in batch.collect()) and got


def test_conversations_share_state_groups_and_keep_clocks_of_their_own(spark, tmp_path, monkeypatch):
    """One state row per group, not per conversation; a group's idle conversations leave while another one goes on."""
    monkeypatch.setattr(packets, "CONVERSATION_GROUPS", 1)
    batches = [
        [(0, 1000, 1, GET[:12]), (1, 1000, 2, GET % 2), (2, 1000, 3, GET[:9])],
        [(3, 1001, 2, GET % 3), (4, 1002, 3, GET[:5])],
    ]
    found = run_messages(spark, tmp_path, batches, keep_seconds=0.001)
    assert found == [("1", 0, "freed", 12), ("2", 1, "request", "/2"), ("2", 3, "request", "/3")]
    states = spark.read.format("statestore").load(str(tmp_path / "state"))
    assert states.count() == 1
