"""Hex decoding and encoding, byte access, sliding byte windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters stripped around a payload line: the ASCII white space.
_BLANKS = " \t\n\r\x0b\x0c"
# Bytes of a payload that are windowed as one slice; bounds the offset array of a row.
SLICE = 1 << 20


def hex_decode(text: Column, *, inner_space: bool = False) -> Column:
    """Bytes of a hex string, NULL if it is not strict hex of even length.

    White space around the text is dropped. With ``inner_space`` blanks may also stand
    between two bytes, but never inside one.
    """
    body = F.btrim(text, F.lit(_BLANKS))
    if inner_space:
        tokens = F.split(body, r"\s+")
        whole_bytes = F.forall(tokens, lambda token: F.length(token) % 2 == 0)
        body = F.when(
            body.rlike(r"\s"), F.when(whole_bytes, F.concat_ws("", tokens))
        ).otherwise(body)
    return F.when(F.length(body) % 2 == 0, F.unhex(body))


def hex_encode(data: Column) -> Column:
    """Lower-case hex text of bytes."""
    return F.lower(F.hex(data))


def uint(data: Column, at: Column | int, size: int) -> Column:
    """Big-endian unsigned integer of ``size`` (< 8) bytes at 1-based position ``at``."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(data, at, F.lit(size))), 16, 10).cast("long")


def byte_values(data: Column) -> Column:
    """Array of the unsigned byte values."""
    return F.transform(F.split(F.decode(data, "ISO-8859-1"), ""), F.ascii)


def num_windows(payload: Column, n: int, max_wins: int | None = None) -> Column:
    """Number of n-byte windows, 0 for a payload shorter than n."""
    count = F.greatest(F.length(payload) - (n - 1), F.lit(0))
    return F.least(count, F.lit(max_wins)) if max_wins else count


def slices(
    df: DataFrame,
    n: int,
    *,
    payload: str = "payload",
    keep: tuple[str, ...] = (),
    max_wins: int | None = None,
    slice_bytes: int = SLICE,
) -> DataFrame:
    """Overlapping parts of each payload of at least n bytes: ``keep``, from, count, slice.

    A part starts at window ``_from`` and holds ``_count`` whole windows, ``slice_bytes`` at
    most, so that the offset array of a row stays small whatever the payload size.
    """
    data = F.col(payload)
    wins = num_windows(data, n, max_wins)
    starts = df.where(F.length(data) >= n).select(
        *keep,
        data.alias("_data"),
        wins.alias("_wins"),
        F.explode(F.sequence(F.lit(0), wins - 1, F.lit(slice_bytes))).alias("_from"),
    )
    return starts.select(
        *keep,
        "_from",
        F.least(F.col("_wins") - F.col("_from"), F.lit(slice_bytes)).alias("_count"),
        F.substring("_data", F.col("_from") + 1, F.lit(slice_bytes + n - 1)).alias("_slice"),
    )


def windows(
    df: DataFrame,
    n: int,
    *,
    payload: str = "payload",
    keep: tuple[str, ...] = (),
    max_wins: int | None = None,
    out: str = "gram",
    slice_bytes: int = SLICE,
) -> DataFrame:
    """One row per n-byte window at step 1: ``keep``, 0-based offset ``i``, the window.

    ``max_wins`` keeps only that many windows from the start of each payload; the default
    takes all.
    """
    parts = slices(
        df, n, payload=payload, keep=keep, max_wins=max_wins, slice_bytes=slice_bytes
    )
    return parts.select(
        *keep,
        "_from",
        "_slice",
        F.explode(F.sequence(F.lit(1), F.col("_count"))).alias("_at"),
    ).select(
        *keep,
        (F.col("_from") + F.col("_at") - 1).cast("long").alias("i"),
        F.substring("_slice", F.col("_at"), F.lit(n)).alias(out),
    )
