"""Seeded 64-bit hashes, slots and signs; the polynomial string hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bytesieve.functions.codec import byte_values

# Fixed values of the polynomial hash.
POLY_BASE = 257
POLY_MOD = 1_000_000_007

_GOLDEN = 0x9E3779B97F4A7C15


def seed(number: int) -> int:
    """The signed 64-bit seed of hash function ``number`` (0, 1, ...)."""
    value = (number + 1) * _GOLDEN % (1 << 64)
    return value - (1 << 64) if value >= 1 << 63 else value


def seeded_hash(data: Column, number: int) -> Column:
    """Signed 64-bit hash of bytes under seed ``number``."""
    return F.xxhash64(F.lit(seed(number)), data)


def slot(data: Column, number: int, slots: int) -> Column:
    """Slot in ``0 .. slots-1`` that hash ``number`` gives to the bytes."""
    return F.pmod(seeded_hash(data, number), F.lit(slots).cast("long"))


def sign(data: Column, number: int) -> Column:
    """+1 or -1 from the parity of the hash's upper half against its lower half."""
    value = seeded_hash(data, number)
    parity = F.shiftrightunsigned(value, 32).bitwiseXOR(value).bitwiseAND(F.lit(1))
    return F.when(parity == 1, F.lit(1)).otherwise(F.lit(-1)).cast("long")


def slots_of(data: Column, k: int, slots: int) -> Column:
    """Array of the k slots of the bytes."""
    return F.array(*[slot(data, number, slots) for number in range(k)])


def poly_hash(data: Column) -> Column:
    """Polynomial hash over unsigned bytes, most significant byte first."""
    base, mod = F.lit(POLY_BASE).cast("long"), F.lit(POLY_MOD).cast("long")
    return F.when(F.length(data) == 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(
            byte_values(data), F.lit(0).cast("long"), lambda acc, b: (acc * base + b) % mod
        )
    )
