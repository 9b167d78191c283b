import math

import pytest
from pyspark.sql import functions as F

from bytesieve.functions import sizing
from bytesieve.functions.codec import hex_decode, hex_encode, windows
from bytesieve.functions.hashing import poly_hash, sign, slot
from bytesieve.operators.search import position


def test_hex_dialects(spark):
    lines = [" 6162 ", "abc", "ab cd", "zz", "", "a b", "AB\n", "ab\tcd  ef", "abcdz1", None]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, h string")
    rows = df.select(
        "i",
        hex_encode(hex_decode(F.col("h"))).alias("strict"),
        hex_encode(hex_decode(F.col("h"), inner_space=True)).alias("lenient"),
    ).orderBy("i").collect()
    assert [r["strict"] for r in rows] == ["6162", None, None, None, "", None, "ab", None, None, None]
    assert [r["lenient"] for r in rows] == ["6162", None, "abcd", None, "", None, "ab", "abcdef", None, None]


@pytest.mark.parametrize("n,cap,slice_bytes", [(3, None, 1 << 20), (3, None, 4), (5, 2, 1 << 20), (1, 7, 3), (3, 6, 3)])
def test_windows_match_slicing(payload_table, n, cap, slice_bytes):
    payloads = [b"", b"ab", b"abc", bytes(range(200)), b"\x00" * 9, "é漢字".encode() * 3]
    got = windows(payload_table(payloads), n, keep=("doc_id",), max_wins=cap, slice_bytes=slice_bytes)
    expected = [
        (d, i, p[i : i + n])
        for d, p in enumerate(payloads)
        for i in range(min(max(len(p) - n + 1, 0), cap or 10**9))
    ]
    assert sorted((r["doc_id"], r["i"], bytes(r["gram"])) for r in got.collect()) == sorted(expected)


def _poly(data):
    value = 0
    for byte in data:
        value = (value * 257 + byte) % 1_000_000_007
    return value


def test_poly_hash(spark):
    data = [b"waldo", b"", b"\x00", b"\xff\x80\x00z", bytes(range(256)) * 3]
    df = spark.createDataFrame([(bytearray(d),) for d in data], "d binary")
    assert [r[0] for r in df.select(poly_hash(F.col("d"))).collect()] == [_poly(d) for d in data]
    assert _poly(b"waldo") == 787668703


def test_position(spark):
    pairs = [
        (b"waldo", b"willy werther warhol wendy --> waldo <--"),
        (b"", b"abc"),
        (b"x", b"abc"),
        (b"\x80", "é".encode() + b"\x80"),
        (b"abc", b""),
        ("ñ".encode(), "ééñ".encode()),
    ]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in pairs], "n binary, h binary")
    got = [r[0] for r in df.select(position(F.col("n"), F.col("h"))).collect()]
    assert got == [h.find(n) if n else -1 for n, h in pairs]
    assert got[0] == 31


def test_slots_and_signs(spark):
    grams = spark.range(4000).select(F.unhex(F.lpad(F.hex("id"), 10, "0")).alias("g"))
    rows = grams.select(
        slot(F.col("g"), 0, 97).alias("a"), slot(F.col("g"), 1, 97).alias("b"), sign(F.col("g"), 0).alias("s")
    ).collect()
    assert all(0 <= r["a"] < 97 and 0 <= r["b"] < 97 and r["s"] in (-1, 1) for r in rows)
    assert sum(r["a"] == r["b"] for r in rows) < 120
    assert abs(sum(r["s"] for r in rows)) < 300


def test_sizing_formulas(spark):
    row = spark.range(1).select(
        sizing.filter_bits(F.lit(10**8), F.lit(8)).alias("bits"),
        sizing.zero_bit_share(F.lit(1154156032), F.lit(10**8), F.lit(8)).alias("p0"),
        sizing.false_adds(F.lit(1154156032), F.lit(10**8), F.lit(8)).alias("no"),
        sizing.unseated_keys(F.lit(1000), F.lit(900), F.lit(8)).alias("seat"),
        sizing.unseen_rate(5, F.lit(10), F.lit(20)).alias("unseen"),
        sizing.collision_share(F.lit(900), F.lit(1000), 8).alias("share"),
        sizing.magnitude(F.lit(-7)).alias("size"),
    ).first()
    assert row["bits"] == 1_154_156_032
    assert row["p0"] == pytest.approx(0.5, abs=1e-6)
    assert row["no"] == 43_402
    assert row["seat"] == pytest.approx(43.0467, abs=1e-4)
    assert row["unseen"] == pytest.approx((256**5 - 30) / 256**5 * 100)
    p0 = 0.9**8 / 9
    assert row["share"] == pytest.approx((math.sqrt(1 + 32 * p0) - 1) / 16)
    assert row["size"] == 7
