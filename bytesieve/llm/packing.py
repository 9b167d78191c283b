"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import itertools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.llm.common import byte_parts, slices, text_or_empty
from bytesieve.session import materialize

# Pieces that one task packs together; a group leaves at most a few sequences unfilled.
GROUP_PIECES = 1 << 16
# Word parts whose ids a Python worker remembers between batches; beyond them it starts anew.
KNOWN_PARTS = 300_000
# The id that ends every document.
END_ID = 0
# Byte-level signs: printable Latin-1 bytes stand for themselves, the others, in order, for the signs from 256 on.
BYTE_SIGNS = {
    byte: 256 + i
    for i, byte in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))
}


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``flat[start:start + size]``, one after another."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]


class WordTokenizer:
    """Token ids of texts through a tokenizer that never joins text across white space.

    Every different word of a batch is tokenised once. A word is cut further between a letter
    and ASCII punctuation behind it, where the pre-tokenizer cuts too, so ``end``, ``end.`` and ``end,`` share
    their letters; ids of such parts are kept in a bounded store.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, parts: list[str]) -> None:
        """Store the ids of new parts.

        Composed lower-case words of letters pass the normalizer and the pre-tokenizer as one word, so their bytes go
        to the model itself. The others are encoded in runs joined by a space and told apart by the offsets of their ids.
        """
        letters, others = [], []
        for part in parts:
            plain = part.isalpha() and (part.isascii() or unicodedata.is_normalized("NFC", part))
            (letters if plain and part == part.lower() else others).append(part)
        tokenize, signs = self.tokenizer.model.tokenize, BYTE_SIGNS
        coded = [
            [token.id for token in tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(signs))]
            for part in letters
        ]
        flats = [self.flat, np.fromiter(itertools.chain.from_iterable(coded), dtype=np.uint32)]
        sizes = [np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))]
        for start in range(0, len(others), 2000):
            run = others[start : start + 2000]
            encoding = self.tokenizer.encode(" ".join(run), add_special_tokens=False)
            ids = np.array(encoding.ids, dtype=np.uint32)
            ends = np.cumsum([len(part) + 1 for part in run])
            first = np.fromiter((o[0] for o in encoding.offsets), dtype=np.int64, count=len(ids))
            sizes.append(np.bincount(np.searchsorted(ends, first, side="right"), minlength=len(run)))
            flats.append(ids)
        if parts:
            names = letters + others
            self.known.update(zip(names, range(len(self.known), len(self.known) + len(names)), strict=True))
            self.flat = np.concatenate(flats)
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one array, offsets of the texts in it), as for each text alone."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        words: pa.Array = coded.dictionary
        # Case folding saves words; strings of special tokens must keep their case.
        folded = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words)).dictionary_encode()
        unique: pa.Array = folded.dictionary
        cut = pc.extract_regex(unique, r"^(?P<head>\p{L}+)(?P<tail>[!-/:-@\[-`{-~].*)$")
        heads = pc.if_else(cut.is_valid(), pc.struct_field(cut, "head"), unique)
        tails = pc.if_else(cut.is_valid(), pc.struct_field(cut, "tail"), "")
        both = pa.concat_arrays([heads, tails]).dictionary_encode()
        names = both.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > KNOWN_PARTS:
            self._forget()
        self._learn([name for name in names if name not in self.known])
        places = np.fromiter(map(self.known.__getitem__, names), dtype=np.int64, count=len(names))

        # Ids of every different word: those of its head, then those of its tail.
        part = places[both.indices.to_numpy(zero_copy_only=False)].reshape(2, -1).T.ravel()
        sizes = np.diff(self.starts)[part]
        flat = _gather(self.flat, self.starts[part], sizes)
        sizes = sizes.reshape(-1, 2).sum(axis=1)
        starts = np.cumsum(sizes) - sizes
        # Ids of the words in text order.
        word = folded.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = sizes[word]
        bounds = np.concatenate([[0], np.cumsum(lengths)])[lists.offsets.to_numpy()]
        return _gather(flat, starts[word], lengths), bounds


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cut_pieces(documents: DataFrame, tokenizer_path: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all documents.

    A document is its token ids and one end id. Only documents longer than ``capacity`` are cut, into pieces of that
    size with the rest in the last one. Null and blank texts are the end id alone. Repeated rows give
    repeated pieces, a null doc_id stays null, other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for part in slices(batches, size=6 << 20):
            ids, bounds = tokenizer.encode(part.column(1))
            columns: list[list] = [[], [], [], [], []]
            row, pieces = [], []
            for i in range(part.num_rows):
                whole = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(END_ID)).astype("<u4")
                for piece, start in enumerate(range(0, len(whole), capacity)):
                    cut = whole[start : start + capacity]
                    row.append(i)
                    for column, value in zip(columns, (piece, start, len(cut), zlib.crc32(cut.tobytes())), strict=False):
                        column.append(value)
                    if with_ids:
                        pieces.append(cut.astype(np.int64))
            arrays = [part.column(0).take(pa.array(row, pa.int64()))]
            arrays += [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:4])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(pieces, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).mapInArrow(run, schema)


class CapacityTree:
    """Open bins by remaining capacity, in a segment tree that finds the tightest one that fits.

    Leaf c holds the bins with c places left; an inner node counts those below it.
    """

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.base)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, number: int) -> None:
        self.bins[remaining].append(number)
        node = self.base + remaining
        while node:
            self.counts[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(remaining, bin) of a bin with the least remaining capacity of at least ``need``."""
        node, counts = self.base + need, self.counts
        if not counts[node]:
            # Up to the first ancestor with bins on its right, then down to the leftmost of them.
            while node > 1 and (node & 1 or not counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if counts[2 * node] else 2 * node + 1
        remaining = node - self.base
        number = self.bins[remaining].pop()
        while node:
            counts[node] -= 1
            node >>= 1
        return remaining, number


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, longest first, each into the tightest open bin."""
    tree, opened = CapacityTree(capacity), 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        found = tree.take(length)
        if found is None:
            found, opened = (capacity, opened), opened + 1
        remaining, number = found
        bins[i], offsets[i] = number, capacity - remaining
        if remaining > length:
            tree.add(remaining - length, number)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, start, length, ids_crc32; a stored table).

    Full pieces are sequences of their own. The others are dealt by hash into groups of about
    ``group_pieces`` and each group is packed in one task. A sequence lies within its group; its id is
    the bin's number times the number of groups plus the group's. An empty table gives no rows.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    # Rows with equal ids and content are interchangeable, whichever way a retry deals them.
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_fit(table["length"].to_numpy(), capacity)
        number = bins * groups + table["group"].to_numpy()
        table = table.drop_columns("group").append_column("sequence_id", pa.array(number))
        yield from table.append_column("offset", pa.array(offsets)).combine_chunks().to_batches(10_000)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.withColumn("group", salt).groupBy("group").applyInArrow(run, schema)


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Tokenise, cut and pack ``documents`` (doc_id, text); see ``cut_pieces`` and ``pack``."""
    return pack(materialize(cut_pieces(documents, tokenizer_path, capacity), "pieces"), capacity)
