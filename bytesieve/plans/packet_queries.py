"""Registered queries over frames, packets, flows and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytesieve.functions.codec import hex_encode
from bytesieve.functions.headers import (
    FLOW,
    PROTO_TCP,
    PROTO_UDP,
    ipv4_text,
    only_protocol,
    parse_frames,
    rewrite_ports,
    tcp_flag_letters,
    tcp_port,
)
from bytesieve.functions.http import message_heads
from bytesieve.operators import flows
from bytesieve.plans.inputs import frames, packets
from bytesieve.plans.registry import query
from bytesieve.plans.sql_parts import DECODED, FRAMES, PACKETS
from bytesieve.session import materialize

DECODED_SQL = f"WITH {PACKETS}, {DECODED}"
FRAMES_SQL = f"WITH {PACKETS}, {FRAMES}"

STREAMS_SQL = f"""{DECODED_SQL}, ends AS (SELECT *,
    CASE WHEN (src, sport) <= (dst, dport) THEN src || ' ' || sport || ' ' || dst || ' ' || dport
         ELSE dst || ' ' || dport || ' ' || src || ' ' || sport END AS conversation FROM decoded WHERE proto = 6),
firsts AS (SELECT conversation, min(packet_no) AS first_packet, count(*) AS packets FROM ends GROUP BY conversation),
streams AS (SELECT *, row_number() OVER (ORDER BY first_packet) - 1 AS stream_id FROM firsts)"""


def _parsed(spark, sf_dir):
    return parse_frames(frames(spark, sf_dir))


def _tcp(spark, sf_dir):
    return only_protocol(_parsed(spark, sf_dir), PROTO_TCP)


@query(
    f"{DECODED_SQL} SELECT packet_no, proto, src, dst, sport, dport, flags, payload_hex FROM decoded"
)
def frame_headers(spark, sf_dir):
    """Header fields and trimmed payload of each IPv4 frame."""
    parsed = _parsed(spark, sf_dir).where(F.col("ethertype") == 2048)
    return parsed.select("packet_no", "proto", *FLOW, "flags", hex_encode(F.col("payload")).alias("payload_hex"))


@query(
    f"""{DECODED_SQL} SELECT packet_no, concat(CASE WHEN flags & 1 > 0 THEN 'F' ELSE '' END,
      CASE WHEN flags & 2 > 0 THEN 'S' ELSE '' END, CASE WHEN flags & 4 > 0 THEN 'R' ELSE '' END,
      CASE WHEN flags & 8 > 0 THEN 'P' ELSE '' END, CASE WHEN flags & 16 > 0 THEN 'A' ELSE '' END,
      CASE WHEN flags & 32 > 0 THEN 'U' ELSE '' END, CASE WHEN flags & 64 > 0 THEN 'E' ELSE '' END,
      CASE WHEN flags & 128 > 0 THEN 'C' ELSE '' END) AS flag_letters FROM decoded WHERE proto = 6"""
)
def tcp_flags(spark, sf_dir):
    """Flag letters of each TCP packet."""
    return _tcp(spark, sf_dir).select("packet_no", tcp_flag_letters(F.col("flags")).alias("flag_letters"))


@query(f"WITH {PACKETS} SELECT packet_no, src, dst FROM packets")
def address_text(spark, sf_dir):
    """Dotted text of the addresses at their fixed place in each frame."""
    frame = F.col("frame")
    return frames(spark, sf_dir).select(
        "packet_no",
        ipv4_text(F.substring(frame, 27, 4)).alias("src"),
        ipv4_text(F.substring(frame, 31, 4)).alias("dst"),
    )


@query(
    f"""{FRAMES_SQL} SELECT packet_no, CASE WHEN packet_no % 50 = 49 OR proto <> 6 THEN frame_hex
      ELSE substr(frame_hex, 1, 68) || CASE WHEN sport = 22 THEN '139e' ELSE substr(frame_hex, 69, 4) END
        || CASE WHEN dport = 22 THEN '139e' ELSE substr(frame_hex, 73, 4) END || substr(frame_hex, 77) END AS frame_hex
    FROM frames"""
)
def port_rewrite(spark, sf_dir):
    """Frames with TCP port 22 turned into 5022 in both directions."""
    mapping = spark.createDataFrame([(22, 5022)], "from_port int, to_port int")
    changed = rewrite_ports(frames(spark, sf_dir), mapping)
    return changed.select("packet_no", hex_encode(F.col("frame")).alias("frame_hex"))


@query(
    f"""WITH {PACKETS}, texts AS (SELECT packet_no, decode(unhex(payload_hex)) AS t FROM packets WHERE packet_no % 50 <> 49)
    SELECT packet_no, CASE WHEN starts_with(t, 'HTTP') THEN 'response' ELSE 'request' END AS kind,
      nullif(regexp_extract(t, '^(GET) (\\S+)', 1), '') AS method, nullif(regexp_extract(t, '^(GET) (\\S+)', 2), '') AS uri,
      TRY_CAST(nullif(regexp_extract(t, '^HTTP/1.1 (\\d+)', 1), '') AS INTEGER) AS status, length(t) AS head_bytes
    FROM texts WHERE starts_with(t, 'HTTP') OR starts_with(t, 'GET ')"""
)
def http_heads(spark, sf_dir):
    """P10: HTTP message heads in packet payloads."""
    heads = message_heads(_tcp(spark, sf_dir), "payload", ("packet_no",))
    return heads.select("packet_no", "kind", "method", "uri", "status", "head_bytes")


@query(
    f"""{DECODED_SQL}, ordered AS (SELECT *, row_number() OVER (PARTITION BY src, dst, sport, dport ORDER BY packet_no) AS rn
      FROM decoded WHERE proto = 6 AND payload_hex <> '')
    SELECT src, dst, sport, dport, CASE WHEN sport = 80 THEN 'response' ELSE 'request' END AS kind,
      CASE WHEN dport = 80 THEN '/item/' || packet_no END AS uri, CASE WHEN sport = 80 THEN 200 END AS status
    FROM ordered WHERE rn = 1 AND (sport = 80 OR dport = 80)"""
)
def first_http_messages(spark, sf_dir):
    """P10: first message of each reassembled flow."""
    heads = flows.first_messages(flows.flow_buffers(_tcp(spark, sf_dir)))
    return heads.select(*FLOW, "kind", "uri", "status")


@query(f"{DECODED_SQL} SELECT proto, count(*) AS packets, CAST(sum(length(payload_hex) // 2) AS BIGINT) AS bytes FROM decoded GROUP BY proto")
def ip_protocols(spark, sf_dir):
    """packets and payload bytes kept per transport protocol."""
    parsed = _parsed(spark, sf_dir)
    kept = only_protocol(parsed, PROTO_TCP).unionByName(only_protocol(parsed, PROTO_UDP))
    return kept.groupBy("proto").agg(
        F.count("*").alias("packets"), F.sum(F.length("payload").cast("long")).alias("bytes")
    )


@query(f"{DECODED_SQL} SELECT packet_no, sport, dport FROM decoded WHERE proto = 6 AND 80 IN (sport, dport)")
def port80_packets(spark, sf_dir):
    """TCP packets from or to port 80."""
    return tcp_port(_parsed(spark, sf_dir)).select("packet_no", "sport", "dport")


@query(
    f"""{DECODED_SQL} SELECT src, dst, sport, dport, count(*) AS packets FROM decoded WHERE proto = 6
    GROUP BY src, dst, sport, dport HAVING max(length(payload_hex)) = 0"""
)
def empty_flows(spark, sf_dir):
    """TCP flows without any payload byte."""
    return flows.empty_flows(_tcp(spark, sf_dir))


@query(
    f"""{DECODED_SQL}, carried AS (SELECT *, sum(length(payload_hex)) OVER (PARTITION BY src, dst, sport, dport
      ORDER BY packet_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS digits FROM decoded WHERE proto = 6)
    SELECT src, dst, sport, dport, packet_no FROM carried WHERE digits = 0"""
)
def empty_buffers(spark, sf_dir):
    """packets after which the buffer of their flow is still empty."""
    return flows.empty_buffers(_tcp(spark, sf_dir))


@query(
    f"""{DECODED_SQL}, listed AS (SELECT DISTINCT src, dst, sport, dport FROM packets WHERE packet_no < 5)
    SELECT d.packet_no FROM decoded d WHERE d.proto = 6 AND NOT EXISTS (SELECT 1 FROM listed l
      WHERE l.src = d.src AND l.dst = d.dst AND l.sport = d.sport AND l.dport = d.dport)"""
)
def excluded_flows(spark, sf_dir):
    """TCP packets outside the excluded 4-tuples (those of the first five packets)."""
    listed = packets(spark, sf_dir).where(F.col("packet_no") < 5).select(*FLOW)
    return flows.exclude_flows(_tcp(spark, sf_dir), materialize(listed, "exclusions")).select("packet_no")


@query(f"{STREAMS_SQL} SELECT e.packet_no, s.stream_id FROM ends e JOIN streams s ON e.conversation = s.conversation")
def stream_numbers(spark, sf_dir):
    """Conversation id of each TCP packet."""
    return flows.with_stream_id(_tcp(spark, sf_dir)).select("packet_no", "stream_id")


@query(f"{STREAMS_SQL} SELECT stream_id, first_packet, packets FROM streams")
def stream_list(spark, sf_dir):
    """Conversations with their first packet and size."""
    return flows.stream_table(_tcp(spark, sf_dir)).select("stream_id", "first_packet", "packets")


def _buffers_sql(chunk: int) -> str:
    return f"""{DECODED_SQL}, joined AS (SELECT src, dst, sport, dport, string_agg(payload_hex, '' ORDER BY packet_no) AS h
      FROM decoded WHERE proto = 6 GROUP BY src, dst, sport, dport),
    cut AS (SELECT *, unnest(range((length(h) + {2 * chunk} - 1) // {2 * chunk})) AS chunk_no FROM joined WHERE h <> '')
    SELECT src, dst, sport, dport, chunk_no, substr(h, chunk_no * {2 * chunk} + 1, {2 * chunk}) AS buffer_hex FROM cut"""


@query(_buffers_sql(1 << 20))
def flow_buffers(spark, sf_dir):
    """Payload of each TCP flow in packet order."""
    built = flows.flow_buffers(_tcp(spark, sf_dir))
    return built.select(*FLOW, "chunk_no", hex_encode(F.col("buffer")).alias("buffer_hex"))


@query(_buffers_sql(64))
def flow_chunks(spark, sf_dir):
    """The same in chunks of 64 bytes, so that packets straddle chunks."""
    built = flows.flow_buffers(_tcp(spark, sf_dir), chunk_bytes=64)
    return built.select(*FLOW, "chunk_no", hex_encode(F.col("buffer")).alias("buffer_hex"))
