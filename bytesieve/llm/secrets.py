"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

Besides strings of known shape, strings that follow a sensitive word are measured: how many bytes do they add
to a zstandard frame primed with identifiers and with the text around them? Identifiers and prose are found
in the dictionary and add little; random keys add nearly their own length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.llm.common import slices, text_or_empty

# The base patterns, over UTF-8 bytes; ASSIGN is searched in bytes with A-Z in lower case.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ASSIGN_LENGTH = 6
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

# Words that make the text behind them sensitive.
SENSITIVE_WORDS = (
    "password passwd passphrase pwd secret token api_key apikey api-key authorization auth bearer credential "
    "private_key private-key access_key access-key signature session_id connection_string"
).split()
# Common identifiers of code and configuration, primed before any text.
IDENTIFIERS = (
    "access_token refresh_token client_secret client_id api_key authorization bearer password username "
    "connection_string database hostname localhost example.com environment getenv os.environ config settings "
    "default null none true false undefined return function class import public private static final string "
    "request response headers content-type application/json charset=utf-8 http:// https:// version signature "
    "session_id user_id created_at updated_at expires_in timestamp placeholder changeme your_api_key_here "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789"
)
# Bytes behind a sensitive word that are searched, and the shortest string measured.
REACH = 64
SHORTEST = 16
# Bytes of a block of text; a candidate's block and its two neighbours prime the dictionary.
AROUND = 2048
# Bytes from which a candidate is measured by a quicker level of compression.
LONG = 4096
# Least share of its own length that a candidate must add to be reported.
NOVELTY = 0.88

_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE_WORDS)).encode())
# One of these is in every text with a sensitive word, and in every text that ASSIGN matches.
_STEMS = (b"pass", b"pwd", b"secret", b"token", b"api", b"auth", b"bearer", b"credential", b"private", b"access",
          b"signature", b"session_id", b"connection_string")
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=~$!@%%^&*-]{%d,}" % SHORTEST)
_DIGIT, _LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]")

Span = tuple[str, int, int]


def base_spans(raw: bytes, low: bytes) -> list[Span]:
    """(kind, start, end) of the fixed patterns: leftmost, non-overlapping within a kind, failing matches dropped."""
    found = [("assign", *match.span()) for match in ASSIGN.finditer(low) if len(match[2]) >= ASSIGN_LENGTH]
    if b"AKIA" in raw:
        found += [("access", *match.span()) for match in ACCESS.finditer(raw)]
    return found


def _mixed(raw: bytes, start: int, end: int) -> bool:
    """Letters and digits both, as in keys; words and plain numbers are not."""
    return bool(_DIGIT.search(raw, start, end) and _LETTER.search(raw, start, end))


class Novelty:
    """Marginal compressed bytes of a string against identifiers and surrounding text."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        import zstandard

        self.zstd = zstandard
        self.identifiers = identifiers.encode()
        self.params = [
            zstandard.ZstdCompressionParameters.from_level(
                level, write_checksum=False, write_content_size=False, write_dict_id=False
            )
            for level in (19, 3)
        ]

    def measure(self, around: bytes):
        """The share of its own bytes (at most 1) that a string adds to an empty frame primed with ``around``.

        Strings beyond ``LONG`` are measured by a quick level, so that one of megabytes takes milliseconds a megabyte.
        """
        primed = self.zstd.ZstdCompressionDict(self.identifiers + around, dict_type=self.zstd.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(compression_params=self.params[0])
        close = self.zstd.ZstdCompressor(dict_data=primed, compression_params=self.params[0])
        nothing = len(close.compress(b""))

        def share(candidate: bytes) -> float:
            compressor, empty = close, nothing
            if len(candidate) > LONG:
                plain = self.zstd.ZstdCompressionDict(self.identifiers + around, dict_type=self.zstd.DICT_TYPE_RAWCONTENT)
                compressor = self.zstd.ZstdCompressor(dict_data=plain, compression_params=self.params[1])
                empty = len(compressor.compress(b""))
            return min(1.0, (len(compressor.compress(candidate)) - empty) / len(candidate))

        return share


def candidates(raw: bytes, low: bytes, taken: list[Span]) -> list[tuple[int, int, int]]:
    """(first start, last start, end) of the strings to be measured, by place; they do not overlap.

    A maximal run of key characters is measured from the first sensitive word it stands behind, and if that is not novel,
    from the last one within it. Starts that would overlap a span of ``taken`` or have no letters and digits fall away.
    """
    words = [word.end() for word in _SENSITIVE.finditer(low)]
    ordered = sorted((start, end) for _, start, end in taken)
    starts = [start for start, _ in ordered]
    reached = list(accumulate((end for _, end in ordered), max))
    found = []
    for run in _CANDIDATE.finditer(raw):
        begin, end = run.span()
        first, behind = bisect_left(words, begin - REACH), bisect_right(words, end - SHORTEST)
        if first >= behind:
            continue
        before = bisect_left(starts, end)
        free = max(begin, reached[before - 1] if before else 0)
        tried = [start for start in (max(begin, words[first]), max(begin, words[behind - 1])) if start >= free]
        tried = [start for start in tried if _mixed(raw, start, end)]
        if tried:
            found.append((tried[0], tried[-1], end))
    return found


def novel_spans(raw: bytes, low: bytes, taken: list[Span], novelty: Novelty, least: float) -> list[Span]:
    """Incompressible strings behind sensitive words, outside the spans ``taken``, each run of characters once.

    The text around is that of the ``AROUND`` bytes in which the string begins and of those before and behind them, without
    any string that is measured: a secret repeated near by must not explain itself. Time is in proportion to the bytes.
    """
    measured = candidates(raw, low, taken)
    others = bytearray(raw)
    for start, _, end in measured:
        others[start:end] = b" " * (end - start)
    found, block, share = [], -1, None
    for first, last, end in measured:
        if first // AROUND != block:
            block = first // AROUND
            share = novelty.measure(bytes(others[max(0, (block - 1) * AROUND) : (block + 2) * AROUND]))
        for start in (first, last) if last > first else (first,):
            if share(raw[start:end]) >= least:
                found.append(("novel", start, end))
                break
    return found


def secret_spans(raw: bytes, novelty: Novelty, least: float = NOVELTY) -> list[Span]:
    """All spans of a UTF-8 text in code points, by start, then in the order of ``KINDS``."""
    found: list[Span] = [("hex", *match.span()) for match in HEX.finditer(raw)]
    low = raw.lower()
    stems = any(stem in low for stem in _STEMS)
    if stems or b"AKIA" in raw:
        found += base_spans(raw, low)
    if stems:
        found += novel_spans(raw, low, found, novelty, least)
    found.sort(key=lambda span: (span[1], KINDS.index(span[0])))
    if found and not raw.isascii():
        # Bytes that begin a code point, counted up to each end of a span.
        begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        upto = np.concatenate([[0], np.cumsum(begins)])
        found = [(kind, int(upto[start]), int(upto[end])) for kind, start, end in found]
    return found


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(documents: DataFrame, least: float = NOVELTY, identifiers: str = IDENTIFIERS) -> DataFrame:
    """(doc_id, spans) of every document; spans are (kind, start, end) in code points, end exclusive.

    Null and empty texts have no spans. Very long texts are scanned whole, in time in proportion to their bytes. Repeated
    rows give repeated results, a null doc_id stays null, other columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for part in slices(batches):
            spans = [
                [{"kind": kind, "start": start, "end": end} for kind, start, end in secret_spans(text, novelty, least)]
                for text in part.column(1).cast(pa.binary()).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, SPAN_TYPE)], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    out, end = [], 0
    for _, start, stop in spans:
        if start >= end or not out:
            out += [text[end:start], mark]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def redact(documents: DataFrame, least: float = NOVELTY, identifiers: str = IDENTIFIERS) -> DataFrame:
    """``documents`` with all secrets replaced, n_chars (if there) counted anew; all columns and rows stay.

    Only texts with a secret change; a null text stays null.
    """
    names = documents.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for part in slices(batches):
            texts = part.column(place).cast(pa.binary()).to_pylist()
            for i, text in enumerate(texts):
                if text and (spans := secret_spans(text, novelty, least)):
                    texts[i] = redacted(text.decode(), spans).encode()
            arrays = part.columns
            arrays[place] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([part.schema.field(i) for i in range(len(names))]))

    changed = documents.mapInArrow(run, documents.schema)
    if "n_chars" in names:
        kind = documents.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return changed.select(*names)
