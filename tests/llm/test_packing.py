import zlib

import numpy as np
import pyarrow as pa
import pytest

from bytesieve.llm import packing
from bytesieve.llm.queries import tokenizer_path

HARD = [
    "", "  ", None, "It's <|endoftext|> don't<|ENDOFTEXT|>x<|startoftext|>. İstanbul ΑΣΣ. éx' cáfe'll 12ab!'s a'S 'tis nb q \x1c",
    "O'clock'd ''s 'sx's. x'sy x'9 x.́y .́ á", "\x0b a\tb\r\n", "日本語 テキスト。ﬁ ½ ‘x’s é.s",
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_equal_the_tokenizer(plain):
    tokenizer = packing.WordTokenizer(tokenizer_path())
    for _ in range(2):
        ids, bounds = tokenizer.encode(pa.array(HARD))
        assert [[*ids[a:b].tolist(), 0] for a, b in zip(bounds, bounds[1:], strict=False)] == [plain(t) for t in HARD]


def check(pieces, texts, plain, capacity):
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = plain(text)
        rows = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["start"] for r in rows] == list(range(0, len(ids), capacity))
        for r in rows:
            part = ids[r["start"] : r["start"] + capacity]
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    for rows in by_sequence.values():
        end = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= capacity
    return len(by_sequence), sum(r["length"] for r in pieces)


def test_pieces_and_sequences_of_a_table(small_documents, plain):
    texts = {r["doc_id"]: r["text"] for r in small_documents.collect()}
    for capacity, limit in ((2048, 1.01), (100, 1.02)):
        used, total = check(packing.pack_documents(small_documents, tokenizer_path(), capacity).collect(), texts, plain, capacity)
        assert used <= limit * total / capacity + 1


def test_several_groups(small_documents, plain):
    from bytesieve.session import materialize

    pieces = materialize(packing.cut_pieces(small_documents, tokenizer_path(), 2048), "t")
    texts = {r["doc_id"]: r["text"] for r in small_documents.collect()}
    used, total = check(packing.pack(pieces, 2048, group_pieces=300).collect(), texts, plain, 2048)
    assert used <= 1.05 * total / 2048 + 4


def test_best_fit_takes_the_tightest_bin():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 101, 800)
    bins, offsets = packing.best_fit(lengths, 100)
    left = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [i for i, room in enumerate(left) if room >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(100 - n)
    assert len(left) == bins.max() + 1
    assert sorted(100 - np.bincount(bins, lengths)) == sorted(left)


def test_odd_rows(odd, nothing):
    rows = packing.pack_documents(odd, tokenizer_path()).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert sorted(r["length"] for r in rows if r["doc_id"] in (2, 3, 4)) == [1, 1, 1]
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 60_001
    assert sum(r["doc_id"] is None for r in rows) == 2 and sum(r["doc_id"] == 1 for r in rows) == 2
    assert packing.pack_documents(nothing, tokenizer_path()).collect() == []
    ids = packing.cut_pieces(odd.where("doc_id = 9"), tokenizer_path(), 2048, with_ids=True).first()["ids"]
    assert len(ids) == 2 and ids[-1] == 0
