"""Registered queries that go through files: sources, sinks and streams.

Each writes data derived from the whole tables to the shared scratch folder with Spark, reads
it back through the source under test and returns what that source gives.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bytesieve.functions.codec import hex_encode
from bytesieve.functions.headers import FLOW, PROTO_TCP, PROTO_UDP, only_protocol, parse_frames, rewrite_ports, tcp_port
from bytesieve.operators import bloom, counts, flows, order, training, vocabulary
from bytesieve.operators.counts import gram_hex
from bytesieve.plans.gram_queries import CAPACITY, COUNTS, HASHES, N, STEPPED, TIER_COUNTS
from bytesieve.plans import inputs
from bytesieve.plans.inputs import documents, frames, hex_payloads, payloads, texts
from bytesieve.plans.packet_queries import DECODED_SQL, FRAMES_SQL, STREAMS_SQL
from bytesieve.plans.registry import query
from bytesieve.plans.sql_parts import PAYLOADS, tiers
from bytesieve.session import materialize, scratch_path
from bytesieve.sources import capture, runs, split_captures, tables
from bytesieve.sources import payloads as lines
from bytesieve.streaming import ingest
from bytesieve.streaming import packets as packet_streams


_MESSAGES_SQL = """CASE WHEN sport = 80 THEN 'response' ELSE 'request' END AS kind,
      CASE WHEN dport = 80 THEN 'GET' END AS method, CASE WHEN dport = 80 THEN '/item/' || packet_no END AS uri,
      CASE WHEN sport = 80 THEN 200 END AS status, CAST(length(payload_hex) // 2 AS BIGINT) AS message_bytes"""
FILES_PER_SOURCE = 4


def _hex_folder(spark, sf_dir) -> str:
    """Payload text files, one folder per source, a source dealt over several tasks."""
    path = scratch_path(spark, "hex-lines")
    dealt = hex_payloads(spark, sf_dir).repartition("source", F.pmod("doc_id", F.lit(FILES_PER_SOURCE)))
    dealt.select("source", "payload_hex").write.partitionBy("source").text(path)
    return path


def _capture_folder(spark, sf_dir) -> str:
    path = scratch_path(spark, "captures")
    capture.write_captures(frames(spark, sf_dir), path)
    return path


@query(
    f"""WITH {PAYLOADS} SELECT source, count(*) AS payloads, CAST(sum(octet_length(payload)) AS BIGINT) AS bytes
    FROM payloads GROUP BY source"""
)
def hex_line_scan(spark, sf_dir):
    """A1: hex payload lines read from text files."""
    scanned = counts.decoded(lines.hex_lines(spark, _hex_folder(spark, sf_dir) + "/*"))
    source = F.regexp_extract("file", r"source=([^/]+)/", 1)
    return scanned.groupBy(source.alias("source")).agg(
        F.count("*").alias("payloads"), F.sum(F.length("payload").cast("long")).alias("bytes")
    )


@query(
    f"""WITH {PAYLOADS}, runs AS (SELECT source, CAST((row_number() OVER (ORDER BY source) - 1) // 7 + 1 AS INTEGER) AS run
      FROM (SELECT DISTINCT source FROM payloads))
    SELECT r.run, p.source, count(*) AS payloads FROM payloads p JOIN runs r ON p.source = r.source GROUP BY r.run, p.source"""
)
def file_ingest_runs(spark, sf_dir):
    """A2: all inputs taken in runs of at most seven unused names in order."""
    folder = _hex_folder(spark, sf_dir)
    found = lines.file_names(spark, folder + "/*")
    names = materialize(
        found.select(F.regexp_extract("name", r"source=([^/]+)/", 1).alias("name")).distinct(), "names"
    )
    used = spark.createDataFrame([], "name string")
    result = None
    run = 0
    # One pass per run of the job, as a schedule would start them.
    while True:
        run += 1
        taken = materialize(lines.unused_files(names, used, 7), "taken")
        chosen = [row["name"] for row in taken.collect()]
        if not chosen:
            return result
        read = lines.hex_lines(spark, [f"{folder}/source={name}" for name in chosen])
        summary = read.groupBy(F.regexp_extract("file", r"source=([^/]+)/", 1).alias("source")).agg(
            F.count("*").alias("payloads")
        )
        part = summary.select(F.lit(run).alias("run"), "source", "payloads")
        result = part if result is None else result.unionByName(part)
        used = used.unionByName(taken)


TIER_FILES, TIER_CAPACITY = 4, 20_000


@query(
    f"""{tiers(N)} SELECT 'gold' AS tier, gram_hex, cnt FROM gold UNION ALL SELECT 'bad', gram_hex, cnt FROM bad
    UNION ALL SELECT 'normal', gram_hex, cnt FROM normal"""
)
def tier_runs(spark, sf_dir):
    """Every tier trained in runs of a few files each, its parts added up.

    The schedule starts runs until no file is left; each finds what to do in the last commit record.
    """
    folder, root = scratch_path(spark, "tier-files"), scratch_path(spark, "tier-state")
    tiered = payloads(spark, sf_dir).select("tier", F.pmod("doc_id", F.lit(TIER_FILES)).alias("file"), F.lower(F.hex("payload")).alias("value"))
    tiered.repartition("tier", "file").write.partitionBy("tier", "file").text(folder)
    for tier in ("gold", "bad", "normal"):
        while training.train_run(spark, root, tier, f"{folder}/tier={tier}/*", files=2, n=N, capacity=TIER_CAPACITY):
            pass
    state = runs.latest_state(spark, root)
    trained = [
        training.tier_counts(spark, root, state, tier).select(F.lit(tier).alias("tier"), gram_hex(), "cnt")
        for tier in ("gold", "bad", "normal")
    ]
    return trained[0].unionByName(trained[1]).unionByName(trained[2])


@query(
    """WITH split AS (SELECT encode(unnest(string_split(text, chr(10))) || chr(10)) AS line FROM documents)
    SELECT count(*) AS lines, CAST(sum(octet_length(line)) AS BIGINT) AS bytes,
      CAST(sum(CASE WHEN octet_length(line) >= 5 THEN octet_length(line) - 3 ELSE 0 END) AS BIGINT) AS wins FROM split"""
)
def raw_line_scan(spark, sf_dir):
    """A3: byte lines of text files with their line end, and their four-byte windows."""
    path = scratch_path(spark, "raw-lines")
    documents(spark, sf_dir).select("text").write.text(path)
    size = F.length("payload")
    return lines.raw_lines(spark, path, keep_end=True).agg(
        F.count("*").alias("lines"),
        F.sum(size.cast("long")).alias("bytes"),
        F.sum(F.when(size >= 5, size - 3).otherwise(0).cast("long")).alias("wins"),
    )


@query(f"{COUNTS} SELECT gram_hex, cnt FROM counts")
def csv_payload_counts(spark, sf_dir):
    """A4: gram counts of the hex column of CSV files."""
    path = scratch_path(spark, "csv-payloads")
    hex_payloads(spark, sf_dir).select(F.col("payload_hex").alias("payload"), "doc_id").write.csv(path, header=True)
    read = counts.decoded(lines.csv_payloads(spark, path))
    return counts.count_grams(read, N).select(gram_hex(), "cnt")


@query(f"{DECODED_SQL} SELECT proto, src, dst, sport, dport, flags, payload_hex FROM decoded")
def capture_packets(spark, sf_dir):
    """A5: packets of capture files."""
    read = parse_frames(capture.read_captures(spark, _capture_folder(spark, sf_dir)))
    ip = read.where(F.col("ethertype") == 2048)
    return ip.select("proto", *FLOW, "flags", hex_encode(F.col("payload")).alias("payload_hex"))


def _captured_tcp(spark, sf_dir):
    """TCP packets of several capture files, numbered through all of them."""
    folder = scratch_path(spark, "rotated")
    # Some files even on one core; a file holds an interval of packets, as rotation leaves them.
    capture.write_captures(frames(spark, sf_dir), folder, files=5)
    numbered = capture.number_frames(capture.read_captures(spark, folder))
    return only_protocol(parse_frames(numbered), PROTO_TCP)


@query(
    f"""{DECODED_SQL} SELECT src, dst, sport, dport, 0::BIGINT AS chunk_no,
      string_agg(payload_hex, '' ORDER BY ts_us, packet_no) AS buffer_hex
    FROM decoded WHERE proto = 6 GROUP BY src, dst, sport, dport HAVING string_agg(payload_hex, '') <> ''"""
)
def capture_flow_buffers(spark, sf_dir):
    """Flows whose packets lie in several capture files."""
    built = flows.flow_buffers(_captured_tcp(spark, sf_dir))
    return built.select(*FLOW, "chunk_no", hex_encode(F.col("buffer")).alias("buffer_hex"))


@query(
    f"""{DECODED_SQL}, timed AS (SELECT *, row_number() OVER (ORDER BY ts_us, packet_no) AS place,
        least(src || ' ' || lpad(sport::VARCHAR, 5, '0') || '|' || dst || ' ' || lpad(dport::VARCHAR, 5, '0'),
          dst || ' ' || lpad(dport::VARCHAR, 5, '0') || '|' || src || ' ' || lpad(sport::VARCHAR, 5, '0')) AS pair
      FROM decoded WHERE proto = 6)
    SELECT row_number() OVER (ORDER BY min(place)) - 1 AS stream_id, count(*) AS packets FROM timed GROUP BY pair"""
)
def capture_stream_list(spark, sf_dir):
    """Conversations over several capture files, numbered by their first packet."""
    return flows.stream_table(_captured_tcp(spark, sf_dir)).select("stream_id", "packets")


@query(f"{FRAMES_SQL} SELECT ts_us, frame_hex FROM frames")
def split_capture_packets(spark, sf_dir):
    """A5: capture files read in ranges of a quarter of a megabyte, several tasks per file."""
    path = scratch_path(spark, "captures")
    capture.write_captures(frames(spark, sf_dir), path, files=2)
    read = split_captures.read_split_captures(spark, path, split_bytes=1 << 18)
    return read.select(F.expr("ts_ns div 1000").alias("ts_us"), hex_encode(F.col("frame")).alias("frame_hex"))


@query(f"{FRAMES_SQL} SELECT ts_us, frame_hex FROM frames")
def capture_round_trip(spark, sf_dir):
    """Frames and times written as capture files and read back."""
    read = capture.read_captures(spark, _capture_folder(spark, sf_dir))
    return read.select(F.expr("ts_ns div 1000").alias("ts_us"), hex_encode(F.col("frame")).alias("frame_hex"))


def _through_captures(spark, changed):
    """Frames of capture files, changed, written as capture files and read back."""
    path = scratch_path(spark, "changed")
    capture.write_captures(changed, path)
    read = capture.read_captures(spark, path)
    return read.select(F.expr("ts_ns div 1000").alias("ts_us"), hex_encode(F.col("frame")).alias("frame_hex"))


@query(f"{FRAMES_SQL} SELECT ts_us, frame_hex FROM frames WHERE packet_no % 50 <> 49 AND proto = 6 AND 80 IN (sport, dport)")
def filtered_capture(spark, sf_dir):
    """Port-80 frames of capture files, written as capture files of their own."""
    numbered = capture.number_frames(capture.read_captures(spark, _capture_folder(spark, sf_dir)))
    kept = tcp_port(parse_frames(numbered.withColumn("data", F.col("frame"))))
    return _through_captures(spark, kept.select("packet_no", "ts_ns", F.col("data").alias("frame")))


@query(
    f"""{FRAMES_SQL} SELECT ts_us, CASE WHEN packet_no % 50 = 49 OR proto <> 6 THEN frame_hex
      ELSE substr(frame_hex, 1, 68) || CASE WHEN sport = 22 THEN '139e' ELSE substr(frame_hex, 69, 4) END
        || CASE WHEN dport = 22 THEN '139e' ELSE substr(frame_hex, 73, 4) END || substr(frame_hex, 77) END AS frame_hex
    FROM frames"""
)
def rewritten_capture(spark, sf_dir):
    """Capture files with TCP port 22 turned into 5022, written as capture files."""
    numbered = capture.number_frames(capture.read_captures(spark, _capture_folder(spark, sf_dir)))
    mapping = spark.createDataFrame([(22, 5022)], "from_port int, to_port int")
    return _through_captures(spark, rewrite_ports(numbered, mapping))


@query(
    f"""{DECODED_SQL} SELECT src, dst, sport, dport, ts_us, {_MESSAGES_SQL}
    FROM decoded WHERE proto = 6 AND 80 IN (sport, dport)"""
)
def flow_messages_batch(spark, sf_dir):
    """P10: all messages of all conversations, each of which lies in two packets, and all lost bytes: none."""
    frames_of = parse_frames(_cut_frames(spark, sf_dir))
    found = flows.all_messages(only_protocol(frames_of, PROTO_TCP), idle_seconds=400 * 86_400)
    return found.drop("path", "packet_no")


@query(
    f"""{STREAMS_SQL} SELECT s.stream_id, count(*) AS packets, CAST(sum(length(e.payload_hex) // 2) AS BIGINT) AS bytes
    FROM ends e JOIN streams s ON e.conversation = s.conversation GROUP BY s.stream_id"""
)
def stream_files(spark, sf_dir):
    """Packets split by TCP stream, streams in order in folders of neighbouring ones, read back."""
    path = scratch_path(spark, "streams")
    tcp = only_protocol(parse_frames(frames(spark, sf_dir)), PROTO_TCP)
    # Stored once: streams are listed, looked up and dealt out from it.
    tcp = materialize(tcp.select("packet_no", "proto", *FLOW, "payload"), "tcp")
    flows.write_streams(flows.with_stream_id(tcp).select("stream_id", "packet_no", "payload"), path)
    read = spark.read.schema("packet_no long, payload binary, stream_id long").parquet(path)
    return read.groupBy("stream_id").agg(
        F.count("*").alias("packets"), F.sum(F.length("payload").cast("long")).alias("bytes")
    )


@query(f"{TIER_COUNTS} SELECT tier, gram_hex, cnt * 2 AS cnt FROM counts")
def saved_counts(spark, sf_dir):
    """A count table saved, loaded, added to itself, saved over itself and loaded again."""
    path = scratch_path(spark, "saved-counts")
    tables.save_counts(counts.count_grams(payloads(spark, sf_dir), N, by=("tier",)), path)
    loaded = tables.load_counts(spark, path)
    tables.save_counts(counts.merge_counts(loaded, loaded, by=("tier",)), path)
    return tables.load_counts(spark, path).select("tier", gram_hex(), "cnt")


@query(
    f"""{STEPPED}, firsts AS (SELECT gram_hex, min(step) AS step FROM stepped GROUP BY gram_hex),
    gens AS (SELECT CAST((row_number() OVER (ORDER BY step) - 1) // {CAPACITY} AS INTEGER) AS generation FROM firsts)
    SELECT 'all' AS tier, generation, count(*) AS n_added, {CAPACITY}::BIGINT AS capacity,
      CAST(floor({CAPACITY} * 8.0::DOUBLE / ln(2.0::DOUBLE)) AS BIGINT) AS num_bits, count(*) AS found
    FROM gens GROUP BY generation"""
)
def saved_filters(spark, sf_dir):
    """A10: filter generations saved and loaded; each still finds all of its grams."""
    path = scratch_path(spark, "saved-filters")
    first = vocabulary.first_steps(order.stepped_windows(texts(spark, sf_dir), N, ["doc_id"]))
    vocab = materialize(
        vocabulary.generations(first, CAPACITY).select(F.lit("all").alias("tier"), "generation", "gram"), "vocab"
    )
    keys = ("tier", "generation")
    bits = bloom.bits_for(CAPACITY, HASHES)
    tables.save_filters(
        bloom.build_bloom(vocab, HASHES, bits, by=keys), bloom.bloom_meta(vocab, CAPACITY, HASHES), path
    )
    bitmaps, meta, _ = tables.load_filters(spark, path)
    asked = bloom.probe_bloom(vocab, bitmaps, HASHES, bits, by=keys)
    found = asked.groupBy(*keys).agg(F.count_if("maybe").alias("found"))
    return meta.join(found, list(keys)).select(*keys, "n_added", "capacity", "num_bits", "found")


@query(f"{DECODED_SQL} SELECT src, dst, sport, dport, payload_hex FROM decoded WHERE proto = 17")
def udp_csv(spark, sf_dir):
    """UDP payload rows written as CSV and read back."""
    path = scratch_path(spark, "udp")
    udp = only_protocol(parse_frames(frames(spark, sf_dir)), PROTO_UDP)
    flows.udp_rows(udp).write.csv(path)
    # An empty payload is an empty field.
    return spark.read.schema(
        "src string, dst string, sport int, dport int, payload_hex string"
    ).csv(path).fillna("", ["payload_hex"])


# --- streams ----------------------------------------------------------------------------

@query(f"{FRAMES_SQL} SELECT ts_us, frame_hex FROM frames WHERE packet_no % 50 <> 49 AND proto = 6 AND 80 IN (sport, dport)")
def port80_stream(spark, sf_dir):
    """Port-80 frames from a stream of rotated capture files."""
    out, state = scratch_path(spark, "port80"), scratch_path(spark, "port80-state")
    stream = packet_streams.port_stream(packet_streams.frame_stream(spark, _capture_folder(spark, sf_dir), files_per_batch=4))
    stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(
        out
    ).awaitTermination()
    read = spark.read.schema("ts timestamp, frame_hex string").parquet(out)
    return read.select(F.unix_micros("ts").alias("ts_us"), "frame_hex")


@query(f"{COUNTS} SELECT gram_hex, cnt FROM counts")
def streamed_counts(spark, sf_dir):
    """H1: counts ingested file by file over several batches, then compacted."""
    deltas, state = scratch_path(spark, "deltas"), scratch_path(spark, "deltas-state")
    ingest.ingest_counts(spark, _hex_folder(spark, sf_dir) + "/*", deltas, state, N, files_per_batch=28)
    total = ingest.compact_counts(spark, deltas, scratch_path(spark, "compacted"))
    return total.select(gram_hex(), "cnt")


@query(f"{COUNTS} SELECT gram_hex, cnt FROM counts WHERE cnt >= 2")
def streamed_second_sightings(spark, sf_dir):
    """H2: grams that a stream has seen twice or more."""
    deltas, state = scratch_path(spark, "seen"), scratch_path(spark, "seen-state")
    ingest.ingest_second_sightings(spark, _hex_folder(spark, sf_dir) + "/*", deltas, state, N, files_per_batch=28)
    return ingest.second_sighting_vocabulary(spark, deltas).select(gram_hex(), "cnt")


def _take_new(messages, out: str, state: str) -> None:
    messages.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(
        availableNow=True
    ).start(out).awaitTermination()


def _halves(df, key: str):
    """Rows below and from the middle between the least and the greatest key, as an early and a late delivery."""
    middle = df.agg(((F.min(key) + F.max(key)) / 2).alias("middle"))
    with_middle = df.crossJoin(F.broadcast(middle))
    for early in (True, False):
        side = F.col(key) < F.col("middle")
        yield with_middle.where(side if early else ~side).drop("middle")


@query(
    f"""{DECODED_SQL} SELECT src, dst, sport, dport, packet_no, {_MESSAGES_SQL}
    FROM decoded WHERE proto = 6 AND 80 IN (sport, dport)"""
)
def streamed_messages(spark, sf_dir):
    """H3: HTTP messages of conversations kept as stream state, and rows of lost bytes, of which there are none."""
    source, out, state = (scratch_path(spark, name) for name in ("packets", "messages", "messages-state"))
    session = ingest.state_session(spark)
    tcp = only_protocol(parse_frames(frames(spark, sf_dir)), PROTO_TCP)
    # Stored once: each delivery then looks for the middle and for its ranges without framing and parsing anew.
    parsed = materialize(tcp.select("packet_no", "ts", *FLOW, "payload"), "tcp")
    for delivery in _halves(parsed, "packet_no"):
        delivery.repartitionByRange("packet_no").write.mode("append").parquet(source)
        stream = session.readStream.schema(delivery.schema).parquet(source)
        # Packets in order of their numbers, whose times run to and fro: no pause ends a flow.
        messages = packet_streams.flow_messages(stream, idle_seconds=400 * 86_400)
        _take_new(messages.where("kind <> 'foreign'").drop("ts_us", "path"), out, state)
    return spark.read.schema(flows.MESSAGE_SCHEMA).parquet(out).drop("ts_us", "path")


def _cut_frames(spark, sf_dir):
    """TCP frames of port 80 in order of time, each message cut into two frames within its head."""
    packets = inputs.packets(spark, sf_dir).where("proto = 6 AND 80 IN (sport, dport) AND packet_no % 50 <> 49")
    at = 1 + F.col("packet_no") % 17
    payload = F.col("payload")
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.substring(payload, 1, at.cast("int")).alias("payload")),
        F.struct(F.lit(1).alias("part"), F.substring(payload, (at + 1).cast("int"), F.length(payload)).alias("payload")),
    )
    kept = [name for name in packets.columns if name != "payload"]
    cut = packets.select(*kept, F.col("packet_no").alias("event_no"), F.inline(parts))
    ranked = order.global_rank(cut.withColumn("ts_us", F.unix_micros("ts")), ["ts_us", "event_no", "part"])
    return inputs.framed(ranked.withColumn("packet_no", F.col("rank")))


@query(
    f"""{DECODED_SQL} SELECT src, dst, sport, dport, ts_us, {_MESSAGES_SQL}
    FROM decoded WHERE proto = 6 AND 80 IN (sport, dport)"""
)
def streamed_capture_messages(spark, sf_dir):
    """Messages over packets and rotated capture files, two deliveries of several files each.

    Every message lies in two packets. Late, freed and foreign bytes would be rows of their own; there are none.
    """
    folder, out, state = (scratch_path(spark, name) for name in ("rotating", "messages", "messages-state"))
    session = ingest.state_session(spark)
    captured = materialize(_cut_frames(spark, sf_dir), "cut-frames")
    for run, (delivery, files) in enumerate(zip(_halves(captured, "packet_no"), (3, 2), strict=True)):
        capture.write_captures(delivery, f"{folder}/{run}", files=files)
        parsed = parse_frames(packet_streams.frame_stream(session, f"{folder}/*"))
        messages = packet_streams.flow_messages(only_protocol(parsed, PROTO_TCP), idle_seconds=400 * 86_400)
        _take_new(messages.drop("path", "packet_no"), out, state)
    return spark.read.schema(flows.MESSAGE_SCHEMA).parquet(out).drop("path", "packet_no")


@query(
    f"""WITH {PAYLOADS} SELECT CAST(count(*) AS BIGINT) AS payloads, CAST(0 AS BIGINT) AS undecodable,
      count(*) FILTER (octet_length(payload) < 5) AS too_short,
      CAST(sum(greatest(octet_length(payload) - 4, 0)) AS BIGINT) AS ngrams FROM payloads"""
)
def live_counters(spark, sf_dir):
    """H5: counters kept for each batch of a stream, added over all of them."""
    from bytesieve.functions.codec import hex_decode

    stream = ingest.payload_stream(spark, _hex_folder(spark, sf_dir) + "/*", files_per_batch=28)
    counters = scratch_path(spark, "watched")
    ingest.count_training(
        stream.withColumn("payload", hex_decode(F.col("payload_hex"))), N, counters, scratch_path(spark, "watched-state")
    )
    return ingest.training_counters(spark, counters).agg(
        *[F.sum(name).alias(name) for name in ("payloads", "undecodable", "too_short", "ngrams")]
    )
