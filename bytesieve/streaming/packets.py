"""Packet streams: rotated capture files and HTTP messages per flow."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bytesieve.functions.codec import hex_encode
from bytesieve.functions.headers import FLOW, parse_frames, tcp_port
from bytesieve.functions.http import ConversationCutter
from bytesieve.operators.flows import CONVERSATION, MESSAGE, MESSAGE_SCHEMA, PLACE, conversation_rows, message_row
from bytesieve.sources.capture import split_frames

_FILES = "path string, modificationTime timestamp, length long, content binary"

def frame_stream(
    spark: SparkSession, folder: str, *, files_per_batch: int | None = None, pattern: str = "*.pcap"
) -> DataFrame:
    """Frames of capture files as they are rotated into a folder."""
    reader = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return split_frames(reader.load(folder))


def port_stream(frames: DataFrame, port: int = 80) -> DataFrame:
    """Time and hex of each frame from or to a TCP port."""
    kept = tcp_port(parse_frames(frames.withColumn("data", F.col("frame"))), port)
    return kept.select("ts", hex_encode(F.col("data")).alias("frame_hex"))


# Groups that the conversations are dealt over. A checkpoint keeps its conversations by group, so this stays as it is.
CONVERSATION_GROUPS = 1_024


def flow_messages(packets: DataFrame, *, idle_seconds: int = 3600, keep_seconds: float = 86_400) -> DataFrame:
    """HTTP messages of each conversation, each with the packet that completed it, and all bytes that became none.

    ``packets`` has the flow, ts, packet_no and payload, and path where packets come from several capture files. Packets
    of a conversation are fed in one order, that of (ts, path, packet_no) if there is a path and of packet_no if there is
    none; unfinished messages stay in the stream state, both directions together, so that a reply knows its request.

    No row is dropped. Besides requests and responses there are rows of kind ``late`` (a packet of a later batch that
    belongs before one already fed: its bytes are left out), ``freed`` (the unfinished message of a conversation that paused
    for more than ``idle_seconds`` of packet time and then starts anew, or that had no packet for ``keep_seconds`` of
    processing time when a later batch came, and left the state; at its last packet) and ``foreign`` (bytes that cannot be HTTP); ``message_bytes`` counts the bytes.

    Conversations are dealt over ``CONVERSATION_GROUPS`` groups by the hash of their end points, and the state of a group holds
    each of its conversations with a clock of its own: a call of the group costs far more than feeding a packet, and most
    conversations have few packets. A task holds the rows that one group has in one batch, so bound the batches at the
    source (``maxFilesPerTrigger``). Null payloads are skipped; packets with a null end point are one conversation.
    """
    # A batch without data would be run for the clock alone, over and over, and ``availableNow`` would never end.
    packets.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    several = "path" in packets.columns

    keep_ms = max(1, int(keep_seconds * 1000))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Each conversation's time to leave and what its cutter holds.
        kept: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
        now = state.getCurrentProcessingTimeMs()
        found: list[tuple] = []

        def cutter_of(ends: str) -> ConversationCutter:
            return ConversationCutter(idle_seconds * 1_000_000, several, kept[ends][1] if ends in kept else None)

        def take(ends: str, entries: list[tuple]) -> None:
            found.extend(message_row(tuple(json.loads(ends).values()), entry) for entry in entries)

        if not state.hasTimedOut:
            arrived = pd.concat(list(batches)).sort_values(["ends", *(PLACE if several else PLACE[2:])])
            columns = [arrived[name].tolist() for name in ("ends", "forth", *PLACE, "payload")]
            for ends, rows in groupby(zip(*columns, strict=True), key=itemgetter(0)):
                cutter = cutter_of(ends)
                for _, forth, ts_us, path, number, payload in rows:
                    if payload is not None:
                        take(ends, cutter.feed(int(not forth), (int(ts_us), path, int(number)), bytes(payload)))
                kept[ends] = [now + keep_ms, cutter.state()]
        for ends in [ends for ends, (due, _) in kept.items() if due <= now]:
            take(ends, cutter_of(ends).end())
            del kept[ends]
        if kept:
            state.update((json.dumps(kept),))
            state.setTimeoutDuration(min(due for due, _ in kept.values()) - now)
        else:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=[*FLOW, *PLACE, *MESSAGE]).astype({"status": "Int32"})

    ends = F.to_json(F.struct(*CONVERSATION), {"ignoreNullFields": "false"})
    dealt = conversation_rows(packets).select(
        F.pmod(F.xxhash64(*CONVERSATION), F.lit(CONVERSATION_GROUPS)).alias("dealt"), ends.alias("ends"), "forth", *PLACE, "payload"
    )
    return dealt.groupBy("dealt").applyInPandasWithState(
        update,
        outputStructType=MESSAGE_SCHEMA,
        stateStructType="cutters string",
        outputMode="append",
        timeoutConf=GroupStateTimeout.ProcessingTimeTimeout,
    )
