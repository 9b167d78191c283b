"""Formulas for filter size, fill, false adds, seating and saturation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filter_bits(capacity: Column, k: Column) -> Column:
    """Bits of a filter of ``capacity`` elements and k hashes: floor(n*k/ln 2)."""
    return F.floor(
        capacity.cast("double") * k.cast("double") / F.ln(F.lit(2.0))
    ).cast("long")


def zero_bit_share(bits: Column, added: Column, k: Column) -> Column:
    """Expected share of bits still 0 after ``added`` elements."""
    return F.exp(-k.cast("double") * added.cast("double") / bits.cast("double"))


def false_adds(bits: Column, added: Column, k: Column) -> Column:
    """Expected number of elements refused as already present while filling."""
    full = F.pow(F.lit(1.0) - zero_bit_share(bits, added, k), k.cast("double"))
    return F.floor(added.cast("double") * (full / (F.lit(1.0) + k.cast("double")))).cast("long")


def unseated_keys(slots: Column, keys: Column, k: Column) -> Column:
    """Expected keys without a seat when each tries k slots: N/(k+1) * (N/M)^k."""
    n, seats = keys.cast("double"), k.cast("double")
    return n / (seats + F.lit(1.0)) * F.pow(n / slots.cast("double"), seats)


def collision_share(distinct: Column, slots: Column, k: int) -> Column:
    """Share of keys lost to collisions, estimated from a distinct count, within [0, 1]."""
    raw = F.pow(distinct.cast("double") / slots.cast("double"), F.lit(float(k))) / F.lit(k + 1.0)
    share = (F.sqrt(F.lit(1.0) + F.lit(4.0 * k) * raw) - F.lit(1.0)) / F.lit(2.0 * k)
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))


def unseen_rate(n: int, *added: Column) -> Column:
    """Percentage of all n-byte grams not yet added."""
    total = F.lit(256.0**n)
    left = total
    for count in added:
        left = left - count.cast("double")
    return left / total * F.lit(100.0)


def magnitude(counter: Column) -> Column:
    """Size of a signed counter."""
    return F.abs(counter)
