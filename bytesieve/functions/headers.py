"""Ethernet, IPv4, TCP and UDP header fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytesieve.functions.codec import uint
from bytesieve.session import fence

# Fixed protocol values.
ETHERTYPE_IPV4 = 0x0800
PROTO_TCP = 6
PROTO_UDP = 17
ETHERNET_BYTES = 14
TCP_FLAG_LETTERS = ((1, "F"), (2, "S"), (4, "R"), (8, "P"), (16, "A"), (32, "U"), (64, "E"), (128, "C"))

FLOW = ["src", "dst", "sport", "dport"]


def ipv4_text(address: Column) -> Column:
    """Dotted text of a 4-byte address."""
    return F.concat_ws(".", *[uint(address, at, 1).cast("string") for at in range(1, 5)])


def tcp_flag_letters(flags: Column) -> Column:
    """Letters of the set flags in the order F S R P A U E C."""
    return F.concat_ws(
        "", *[F.when(flags.bitwiseAND(F.lit(bit)) > 0, F.lit(letter)) for bit, letter in TCP_FLAG_LETTERS]
    )


def parse_frames(frames: DataFrame, *, keep_frame: bool = False) -> DataFrame:
    """Header fields of each ``frame``: one row per frame, NULL where a header is cut short.

    Adds ethertype, proto, src, dst, sport, dport, flags and payload. The IPv4 total length
    trims Ethernet padding; 0 means "to the end of the frame". Later fragments have
    no ports and no payload. ``frame`` is dropped unless asked for (with ``l4_at``, the
    1-based position of the TCP or UDP header).
    """
    frame = F.col("frame")
    size = F.length(frame)
    ip_at = ETHERNET_BYTES + 1
    link = frames.withColumn("ethertype", F.when(size >= ETHERNET_BYTES, uint(frame, 13, 2)).cast("int"))
    is_ip = (F.col("ethertype") == ETHERTYPE_IPV4) & (size >= ETHERNET_BYTES + 20)
    network = (
        link.withColumn("_is_ip", is_ip)
        .withColumn("_ihl", F.when(F.col("_is_ip"), uint(frame, ip_at, 1).bitwiseAND(F.lit(15)) * 4))
        .withColumn("_total", F.when(F.col("_is_ip"), uint(frame, ip_at + 2, 2)))
        .withColumn("_fragment", F.when(F.col("_is_ip"), uint(frame, ip_at + 6, 2).bitwiseAND(F.lit(0x1FFF))))
        .withColumn("proto", F.when(F.col("_is_ip"), uint(frame, ip_at + 9, 1)).cast("int"))
        .withColumn("src", F.when(F.col("_is_ip"), ipv4_text(F.substring(frame, ip_at + 12, 4))))
        .withColumn("dst", F.when(F.col("_is_ip"), ipv4_text(F.substring(frame, ip_at + 16, 4))))
        .withColumn("l4_at", (F.col("_ihl") + ip_at).cast("int"))
        .withColumn(
            "_end",
            F.when(F.col("_total") == 0, size).otherwise(
                F.least(size.cast("long"), F.col("_total") + ETHERNET_BYTES)
            ),
        )
    )
    l4 = F.col("l4_at")
    room = F.col("_end") - l4 + 1
    first = F.col("_fragment") == 0
    transport = network.withColumn(
        "_l4",
        F.when(first & (F.col("proto") == PROTO_TCP) & (room >= 20), F.lit(PROTO_TCP)).when(
            first & (F.col("proto") == PROTO_UDP) & (room >= 8), F.lit(PROTO_UDP)
        ),
    )
    is_tcp = F.col("_l4") == PROTO_TCP
    header = F.when(is_tcp, F.shiftright(uint(frame, l4 + 12, 1), 4) * 4).when(
        F.col("_l4") == PROTO_UDP, F.lit(8)
    )
    start = (l4 + F.col("_header")).cast("int")
    length = F.greatest(F.col("_end") - start + 1, F.lit(0)).cast("int")
    parsed = (
        transport.withColumn("sport", F.when(F.col("_l4").isNotNull(), uint(frame, l4, 2)).cast("int"))
        .withColumn("dport", F.when(F.col("_l4").isNotNull(), uint(frame, l4 + 2, 2)).cast("int"))
        .withColumn("flags", F.when(is_tcp, uint(frame, l4 + 13, 1)).when(F.col("_l4").isNotNull(), 0).cast("int"))
        .withColumn("_header", header)
        .withColumn("payload", F.when(F.col("_l4").isNotNull(), F.substring(frame, start, length)))
    )
    kept = frames.columns if keep_frame else [name for name in frames.columns if name != "frame"]
    fields = ["ethertype", "proto", *FLOW, "flags", "payload"]
    return fence(parsed, *kept, *fields, *(["l4_at"] if keep_frame else []))


def only_protocol(packets: DataFrame, proto: int) -> DataFrame:
    """IPv4 packets of one transport protocol with a whole header."""
    return packets.where(
        (F.col("ethertype") == ETHERTYPE_IPV4) & (F.col("proto") == proto) & F.col("sport").isNotNull()
    )


def tcp_port(packets: DataFrame, port: int = 80) -> DataFrame:
    """TCP packets from or to ``port``."""
    return packets.where(
        (F.col("proto") == PROTO_TCP) & ((F.col("sport") == port) | (F.col("dport") == port))
    )


def rewrite_ports(frames: DataFrame, port_map: DataFrame) -> DataFrame:
    """Frames with mapped TCP ports replaced in place, in both directions.

    ``port_map(from_port, to_port)`` has at most one row per 16-bit port, hence the
    broadcast. Checksums are left as they are, and so are frames without a mapped port.
    """
    mapping = port_map.groupBy("from_port").agg(F.min("to_port").alias("to_port")).where(
        F.col("from_port").between(0, 65535)
    )
    looked_up = parse_frames(frames, keep_frame=True)
    for side in ("sport", "dport"):
        to = F.broadcast(mapping.select(F.col("from_port").alias(side), F.col("to_port").alias(f"_new_{side}")))
        looked_up = looked_up.join(to, side, "left")
    result = F.col("frame")
    for side, shift in (("sport", 0), ("dport", 2)):
        value = F.unhex(F.lpad(F.hex(F.col(f"_new_{side}").cast("long")), 4, "0"))
        replaced = F.overlay(result, value, (F.col("l4_at") + shift).cast("int"), F.lit(2))
        result = F.when(F.col(f"_new_{side}").isNotNull() & (F.col("proto") == PROTO_TCP), replaced).otherwise(result)
    columns = [F.col(c) if c != "frame" else result.alias("frame") for c in frames.columns]
    return looked_up.select(*columns)
