"""Payload and packet tables derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesieve.session import fence, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and the text's bytes, for work that needs no tier and so no labels."""
    return documents(spark, sf_dir).select("doc_id", "source", F.col("text").cast("binary").alias("payload"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, tier and the text's bytes; tier by label, ``normal`` without one."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    tier = (
        F.when(F.col("toxic") == 1, F.lit("bad"))
        .when(F.col("quality") == 1, F.lit("gold"))
        .otherwise(F.lit("normal"))
    )
    joined = documents(spark, sf_dir).join(labels, "doc_id", "left")
    return joined.select("doc_id", "source", tier.alias("tier"), F.col("text").cast("binary").alias("payload"))


def hex_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", "source", F.lower(F.hex("payload")).alias("payload_hex"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").cast("binary").alias("payload"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet per event: even ids run from client to server, odd ids back."""
    e, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    events = spread(
        table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props"), "event_id"
    )
    client = F.concat(F.lit("10.0."), F.expr("user_id div 256 % 256"), F.lit("."), user % 256)
    server = F.concat(F.lit("192.168.0."), user % 8)
    client_port = (1024 + user % 64000).cast("int")
    server_port = (
        F.when(kind == "view", 80).when(kind == "click", 443).when(kind == "purchase", 8080)
        .when(kind == "signup", 22).otherwise(53)
    )
    forth = e % 2 == 0
    text = (
        F.when((kind == "view") & forth, F.concat(F.lit("GET /item/"), e, F.lit(" HTTP/1.1\r\nHost: h\r\n\r\n")))
        .when(kind == "view", F.lit("HTTP/1.1 200 OK\r\nContent-Length: 0\r\n\r\n"))
        .when(e % 10 == 7, F.lit(""))
        .otherwise(F.col("props"))
    )
    proto = F.when(kind == "error", 17).otherwise(6)
    return fence(
        events,
        e.alias("packet_no"),
        # The column has no time zone: its digits are UTC.
        F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp").alias("ts"),
        proto.alias("proto"),
        F.when(forth, client).otherwise(server).alias("src"),
        F.when(forth, server).otherwise(client).alias("dst"),
        F.when(forth, client_port).otherwise(server_port).alias("sport"),
        F.when(forth, server_port).otherwise(client_port).alias("dport"),
        F.when(kind == "error", 0).otherwise(e % 256).cast("int").alias("flags"),
        text.cast("binary").alias("payload"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ethernet frames of the packets; every 50th is no IPv4, short ones are padded."""
    return framed(packets(spark, sf_dir))


def framed(packets: DataFrame) -> DataFrame:
    """Ethernet frames of ``packets``; those numbered 49 modulo 50 by ``event_no``, else ``packet_no``, are no IPv4."""

    def word(value: Column, digits: int) -> Column:
        return F.lpad(F.lower(F.hex(value.cast("long"))), digits, "0")

    def address(text: Column) -> Column:
        parts = [word(F.split_part(text, F.lit("."), F.lit(at)), 2) for at in range(1, 5)]
        return F.coalesce(F.concat(*parts), F.lit(""))

    no = F.col("packet_no")
    event = F.col("event_no" if "event_no" in packets.columns else "packet_no")
    size = F.length("payload")
    is_tcp = F.col("proto") == 6
    l4 = F.when(
        is_tcp,
        F.concat(
            word(F.col("sport"), 4), word(F.col("dport"), 4), word(no % (1 << 32), 8), F.lit("0000000050"),
            word(F.col("flags"), 2), F.lit("200000000000"),
        ),
    ).otherwise(
        F.concat(word(F.col("sport"), 4), word(F.col("dport"), 4), word(size + 8, 4), F.lit("0000"))
    )
    whole = F.concat(
        F.lit("020000000002020000000001"),
        F.when(event % 50 == 49, F.lit("86dd")).otherwise(F.lit("0800")),
        F.lit("4500"),
        word(size + F.when(is_tcp, 40).otherwise(28), 4),
        word(no % 65536, 4),
        F.lit("400040"),
        word(F.col("proto"), 2),
        F.lit("0000"),
        address(F.col("src")),
        address(F.col("dst")),
        l4,
        F.lower(F.hex("payload")),
    )
    # Built once per frame, not once for its length and once more for its digits.
    built = fence(packets, "packet_no", "ts", whole.alias("_whole"))
    padded = F.when(F.length("_whole") < 120, F.rpad("_whole", 120, "0")).otherwise(F.col("_whole"))
    return fence(built, "packet_no", "ts", (F.unix_micros("ts") * 1000).alias("ts_ns"), F.unhex(padded).alias("frame"))
