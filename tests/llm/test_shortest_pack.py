import zlib

import numpy as np
import pytest

from bytesieve.llm import shortest_pack
from bytesieve.llm.queries import tokenizer_path


def places(histogram, capacity):
    plan = shortest_pack.shortest_pack_first(histogram, capacity)
    lengths = np.repeat(np.array(list(histogram), np.int64), list(histogram.values()))
    ranks = np.concatenate([np.arange(count) for count in histogram.values()])
    return lengths, shortest_pack.Places(plan, capacity).of(lengths, ranks), plan


def check_filled(capacity, lengths, found):
    unit, skip, size, sequence, offset = found
    assert np.array_equal(np.bincount(unit, weights=size, minlength=len(lengths)), lengths)
    same = unit[1:] == unit[:-1]
    assert np.array_equal(skip[1:], np.where(same, (skip + size)[:-1], 0)) and skip[0] == 0
    order = np.lexsort([offset, sequence])
    same = np.diff(sequence[order]) == 0
    assert np.array_equal(offset[order][1:], np.where(same, (offset + size)[order][:-1], 0))
    filled = np.bincount(sequence, weights=size)
    assert filled.max() <= capacity
    # No padding: every sequence is full or a power of two.
    assert all(n == capacity or int(n) & (int(n) - 1) == 0 for n in filled)


@pytest.mark.parametrize("capacity", [1, 2, 8, 64, 100])
def test_plans_fill_every_sequence(capacity):
    rng = np.random.default_rng(capacity)
    for _ in range(30):
        histogram = {int(n): int(c) for n, c in enumerate(np.bincount(rng.integers(1, capacity + 1, rng.integers(1, 90)))) if c}
        lengths, found, _ = places(histogram, capacity)
        check_filled(capacity, lengths, found)


def test_plan_of_many_units_is_small_and_cuts_few():
    rng = np.random.default_rng(0)
    drawn = np.minimum(4096, rng.lognormal(6, 1, 200_000).astype(int) + 1)
    histogram = {int(n): int(c) for n, c in enumerate(np.bincount(drawn)) if c}
    lengths, found, plan = places(histogram, 4096)
    check_filled(4096, lengths, found)
    assert len(plan) < 20_000
    # Cutting at every sequence's end would cut once per sequence.
    assert len(found[0]) - len(lengths) < 0.6 * lengths.sum() / 4096


def test_shortest_pack_takes_the_next_length():
    """Three packs of ten opened by 7, 5 and 4; twos join the pack that holds least, the last one is cut in two."""
    lengths, (_, _, size, sequence, offset), _ = places({7: 1, 5: 1, 4: 1, 2: 7}, 10)
    at = {(int(s), int(o)): int(n) for n, s, o in zip(size, sequence, offset, strict=True)}
    twos = {(2, 4), (2, 6), (2, 8), (1, 5), (1, 7), (0, 7)}
    assert at == {(0, 0): 7, (1, 0): 5, (2, 0): 4, (0, 9): 1, (1, 9): 1} | dict.fromkeys(twos, 2)


def test_a_length_that_closes_a_pack_is_laid_there():
    _, (unit, _, _, sequence, _), _ = places({6: 1, 5: 1, 4: 1, 3: 5}, 10)
    assert sequence[2] == sequence[0]


def test_hot_length():
    lengths, found, plan = places({1: 10**6, 4095: 10}, 4096)
    check_filled(4096, lengths, found)
    assert len(plan) < 10


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check_pieces(rows, texts, plain, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids, end = plain(text), 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == end and r["doc_tokens"] == len(ids)
            end += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : end], "<u4").tobytes())
        assert end == len(ids)
    for sequence in by_sequence.values():
        end = 0
        for r in sorted(sequence, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end == capacity or (end < capacity and end & (end - 1) == 0)


@pytest.mark.parametrize("capacity", [4096, 100])
def test_pieces_of_a_table(small_documents, plain, capacity):
    texts = {r["doc_id"]: r["text"] for r in small_documents.collect()}
    check_pieces(shortest_pack.pack_documents(small_documents, tokenizer_path(), capacity).collect(), texts, plain, capacity)


def test_ranks_do_not_depend_on_buckets(small_documents):
    units = shortest_pack.units_of(small_documents, tokenizer_path(), 256).persist()
    for size in (50, 1 << 14):
        frame, histogram = shortest_pack.ranked(units, size)
        got = {}
        for r in frame.select("length", "rank").collect():
            got.setdefault(r["length"], []).append(r["rank"])
        assert {n: len(ranks) for n, ranks in got.items()} == histogram
        assert all(sorted(ranks) == list(range(len(ranks))) for ranks in got.values())
    units.unpersist()


def test_odd_rows(odd, nothing, plain):
    rows = shortest_pack.pack_documents(odd, tokenizer_path(), 256, with_ids=True).collect()
    assert sum(r["length"] for r in rows) == sum(len(plain(r["text"])) for r in odd.collect())
    assert all(r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    assert {r["doc_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}
    assert shortest_pack.pack_documents(nothing, tokenizer_path()).collect() == []
