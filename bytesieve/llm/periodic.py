"""Periodic runs of words, found by seeds and extension along diagonals.

A run of period q and length at least max(MIN_LENGTH, 3 q) agrees with itself, q words apart, over at least
max(MIN_LENGTH - q, 2 q) words. So periods up to 16 share a 16-gram with themselves, and periods above K / 2 up to K a
K-gram, for every power of two K above 16. One index of K-grams per such class of periods therefore seeds every run.

Of the occurrences of a K-gram only neighbouring ones are paired: within a run of smallest period q <= K the next
occurrence of any K-gram lies exactly q words on (a nearer one would give the run a smaller period), so these pairs
suffice and a gram with n occurrences gives n - 1 pairs. A pair is extended along its diagonal (its lag) by comparing
words; a table per lag of the furthest place covered keeps later pairs of the same stretch from being extended again.
Grams are indexed by 64-bit hashes. Two different grams with one hash are found when their pair is extended, and the
index is made anew with another salt, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.llm.common import slices, text_or_empty

# A run has at least this many words, and at least REPEATS times its period.
MIN_LENGTH, REPEATS = 24, 3
# Words of the shortest seed: the least that a run with period up to this number shares with itself.
SEED = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word codes, offsets of the texts in them, words by code) of texts cut at ASCII white space, case kept."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    filled = pc.not_equal(flat, "")
    offsets = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])[lists.offsets.to_numpy()]
    coded = flat.filter(filled).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), offsets, coded.dictionary


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _ODD
    return values ^ (values >> np.uint64(29))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring grams from the hashes of each."""
    return _mixed(left * np.uint64(0xD6E8FEB86659FD93) + right)


class Collision(Exception):
    """Different grams of one document with equal hashes."""


def _next_occurrences(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place, next place) with equal hashes; ``places`` are ascending."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    return places[order[:-1][same]], places[order[1:][same]]


def _still_open(here: np.ndarray, there: np.ndarray, size: int) -> np.ndarray:
    """Ascending places of repeated grams in stretches that may belong to a run of a longer period.

    All grams of a run lie in one stretch of neighbouring repeated places. A stretch whose grams all return within half
    their size has one period of at most that (the periods of neighbouring grams agree), so it holds no longer one.
    """
    places = np.union1d(here, there)
    stretch = np.cumsum(np.diff(places, prepend=places[:1]) > 1)
    far = here[there - here > size // 2]
    return places[np.isin(stretch, stretch[np.searchsorted(places, far)])]


def seed_pairs(codes: np.ndarray, offsets: np.ndarray, salt: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(gram size, places, next places) of neighbouring equal grams whose lag belongs to the gram size.

    Equal hashes may be different grams: whoever extends the pairs compares all ``size`` words and raises ``Collision`` if
    they differ. Pairs of a smaller lag are compared here, by their halves, which then have been compared already; no
    gram returns sooner than a shorter one did.
    """
    words = len(codes)
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = offsets[1:][document]
    hashes = _mixed(codes.astype(np.uint64) + np.uint64(salt << 40) + np.uint64(1))
    size = 1
    while size < SEED:
        hashes[: max(0, words - size)] = _joined(hashes[: max(0, words - size)], hashes[size:])
        size *= 2
    hashes ^= _mixed(document.astype(np.uint64) + _ODD)
    places = np.flatnonzero(np.arange(words) + size <= ends)
    shorter, least = hashes, 1
    while len(places):
        here, there = _next_occurrences(hashes[places], places)
        lag, half = there - here, size // 2
        near = lag <= size
        if lag.min(initial=words) < least:
            raise Collision
        if size > SEED:
            near &= lag > half
            inner = lag <= half
            for shift in (0, half):
                if not np.array_equal(shorter[here[inner] + shift], shorter[there[inner] + shift]):
                    raise Collision
        yield size, here[near], there[near]
        places = _still_open(here, there, size)
        # Longer grams repeat only where both halves do; sizes that no lag belongs to are not asked.
        least = int(lag.min(initial=words))
        while len(places):
            open_places = np.zeros(words + 1, bool)
            open_places[places] = True
            places = places[places + 2 * size <= ends[places]]
            places = places[open_places[places + size]]
            shorter, hashes = hashes, hashes.copy()
            hashes[places] = _joined(shorter[places], shorter[places + size])
            size *= 2
            if least <= size:
                break


def _agreement(left: np.ndarray, right: np.ndarray) -> int:
    """Number of equal leading values, compared in blocks of growing size."""
    length, done, block = min(len(left), len(right)), 0, 32
    while done < length:
        differ = left[done : done + block] != right[done : min(length, done + block)][: len(left) - done]
        if differ.any():
            return done + int(differ.argmax())
        done += block
        block *= 2
    return length


def find_runs(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first word, length, period) of all runs of the texts, by place, then period.

    A run is a stretch of words with smallest period q, at least max(MIN_LENGTH, REPEATS q) long, that
    no neighbouring word of its text extends. Time is in proportion to words, their repeats and the words of runs.
    """
    salt = 0
    while True:
        try:
            return _extended(codes, offsets, salt)
        except Collision:
            salt += 1


def _extended(codes: np.ndarray, offsets: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found: list[tuple[int, int, int]] = []
    for size, here, there in seed_pairs(codes, offsets, salt):
        lags = there - here
        order = np.lexsort([here, lags])
        here, lags = here[order], lags[order]
        covered: dict[int, int] = {}
        i = 0
        while i < len(here):
            lag, place = int(lags[i]), int(here[i])
            text = int(np.searchsorted(offsets, place, side="right")) - 1
            begin, end = max(int(offsets[text]), covered.get(lag, 0)), int(offsets[text + 1])
            back = _agreement(codes[begin:place][::-1], codes[begin + lag : place + lag][::-1])
            ahead = _agreement(codes[place : end - lag], codes[place + lag : end])
            if ahead < size:
                raise Collision
            covered[lag] = place + ahead
            length = back + ahead + lag
            if length >= max(MIN_LENGTH, REPEATS * lag):
                found.append((place - back, length, lag))
            # Pairs of this lag that the extension has covered are skipped; each must have agreed over its whole gram.
            last = i + int(np.searchsorted(lags[i:], lag, side="right"))
            i += int(np.searchsorted(here[i:last], covered[lag]))
            if here[i - 1] + size > covered[lag]:
                raise Collision
    runs = np.array(sorted(found, key=lambda run: (run[0], run[2])), np.int64).reshape(-1, 3)
    return runs[:, 0], runs[:, 1], runs[:, 2]


def kept_words(words: int, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Mask of words that no run contains after its first period."""
    change = np.zeros(words + 1, np.int64)
    np.add.at(change, starts + periods, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) == 0


def planted(codes: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Codes of texts in which every tenth one, by its draw, is made periodic; a negative draw leaves a text alone.

    With g = draw // 10 and n words, the words from a = g % n on repeat the first 1 + (n - a) // (3 + g % 8) of them.
    """
    codes = codes.copy()
    for text in np.flatnonzero((draws >= 0) & (draws % 10 == 0) & (np.diff(offsets) > 0)).tolist():
        begin, end, g = int(offsets[text]), int(offsets[text + 1]), int(draws[text]) // 10
        a = g % (end - begin)
        period = 1 + (end - begin - a) // (3 + g % 8)
        codes[begin + a : end] = codes[begin + a + np.arange(end - begin - a) % period]
    return codes


RUNS = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(documents: DataFrame, draw: str | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of each text and the text without the repeats of its runs.

    Runs are by start, then period; words are numbered from 0. ``collapsed`` holds the words that no run contains after
    its first period, joined by one space. With ``draw`` (SQL of a long), texts are changed by ``planted`` before; a null draw
    changes nothing. Null, empty and blank texts have no words and no runs. Each row gives one row, repeated rows and ids
    too; a null doc_id stays null, other columns are ignored, an empty table gives no rows. A text of any length is handled
    whole, in one task, in memory of about twenty times its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size=4 << 20):
            codes, offsets, dictionary = split_words(part.column(1))
            codes = planted(codes, offsets, part.column(2).to_numpy(zero_copy_only=False))
            starts, lengths, periods = find_runs(codes, offsets)
            bounds = np.searchsorted(starts, offsets)
            kept = kept_words(len(codes), starts, lengths, periods)
            texts = np.searchsorted(offsets, starts, side="right") - 1
            runs = pa.StructArray.from_arrays(
                [pa.array(starts - offsets[texts]), pa.array(lengths), pa.array(periods)], ["start", "length", "period"]
            )
            words = dictionary.take(pa.array(codes[kept]))
            left = np.concatenate([[0], np.cumsum(kept)])[offsets]
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words), " ")
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs),
                    collapsed,
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    drawn = F.coalesce(F.expr(draw).cast("long"), F.lit(-1)) if draw else F.lit(-1).cast("long")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(), drawn.alias("draw"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")

