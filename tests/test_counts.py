import random
from collections import Counter

import numpy as np
import pytest
from helpers import gram_dict
from pyspark.sql import functions as F

from bytesieve.functions.codec import windows
from bytesieve.operators import counts, topk

LITERAL = ["abcdef", "1234567890", "3245d3ffeeaabb23459879", "abcdef"]


def brute(payloads, n):
    return Counter(p[i : i + n] for p in payloads for i in range(len(p) - n + 1))


def count_table(spark, entries):
    return spark.createDataFrame([(bytearray(g), c) for g, c in entries], "gram binary, cnt long")


@pytest.mark.parametrize("n,total,distinct", [(3, 14, 13), (5, 8, 8)])
def test_literal_payloads(spark, n, total, distinct):
    df = counts.decoded(spark.createDataFrame([(p,) for p in LITERAL], "payload_hex string"))
    got = gram_dict(counts.count_grams(df, n))
    assert (sum(got.values()), len(got)) == (total, distinct)


def test_exact_counts_keep_trailing_nul(payload_table):
    payloads = [b"ab\x00\x00\x00", b"ab\x00\x00\x01", b"ab\x00\x00\x00", b"ab\x00\x00\x01", b"\x00" * 5]
    got = gram_dict(counts.count_grams(payload_table(payloads), 5))
    assert got == brute(payloads, 5)
    assert got[b"\x00" * 5] == 1


def test_counts_with_one_hot_gram(payload_table):
    rng = random.Random(7)
    payloads = [b" " * 400] * 60 + [rng.randbytes(300) for _ in range(60)]
    got = gram_dict(counts.count_grams(payload_table(payloads), 4))
    assert got == brute(payloads, 4)


def test_drops(spark):
    lines = ["ab", "abc", "zz", "", "0102030405", "0102030405ff"]
    row = counts.drop_counts(spark.createDataFrame([(x,) for x in lines], "payload_hex string"), 5).first()
    assert row.asDict() == {"payloads": 6, "undecodable": 2, "too_short": 2, "kept": 2}


def test_ceiling(spark):
    rows = counts.capped(count_table(spark, [(b"a", 7), (b"b", 5)]), 5).collect()
    assert {(bytes(r["gram"]), r["cnt"], r["ceilings"]) for r in rows} == {(b"a", 5, 2), (b"b", 5, 0)}


def test_merge_of_parts_is_whole(payload_table):
    rng = random.Random(1)
    payloads = [bytes(rng.choices(b"abc", k=50)) for _ in range(40)]
    parts = [counts.count_grams(payload_table(payloads[i::3]), 4) for i in range(3)]
    assert gram_dict(counts.merge_counts(*parts)) == brute(payloads, 4)
    assert max(gram_dict(counts.merge_counts(*parts, ceiling=9)).values()) == 9


def test_lookup(spark):
    table = count_table(spark, [(b"a", 3), (b"b", 4)])
    asked = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"x"),)], "gram binary")
    assert gram_dict(counts.lookup_counts(asked, table)) == {b"a": 3, b"x": 0}


def test_statistics(spark):
    values = [1, 1, 2, 3, 9, 14]
    table = count_table(spark, [(bytes([i]), v) for i, v in enumerate(values)])
    row = counts.count_statistics(table, 100).first()
    door = max(2, sum(values) // (1 + len(values)))
    assert (row["tries"], row["keys"], row["door"]) == (30, 6, door)
    assert row["mean_cnt"] == pytest.approx(np.mean(values))
    assert row["std_cnt"] == pytest.approx(np.std(values))
    assert row["below_door"] == sum(v < door for v in values)
    assert row["load_factor"] == pytest.approx(0.06)


def test_heavy_hitters_exact_without_eviction(payload_table):
    payloads = [b"aaaaaabbbbcc" * 5]
    wins = windows(payload_table(payloads), 3)
    got = {bytes.fromhex(r["gram_hex"]): r["cnt"] for r in counts.heavy_hitters(wins, 5, tracked=1000).collect()}
    expected = brute(payloads, 3)
    assert all(expected[g] == c for g, c in got.items())
    assert sorted(got.values()) == sorted(sorted(expected.values())[-5:])


def test_heavy_hitters_with_eviction_keep_frequent(payload_table):
    rng = random.Random(3)
    payloads = [rng.randbytes(2000) + b"hot!" * 200 for _ in range(20)]
    wins = windows(payload_table(payloads), 4)
    total = sum(len(p) - 3 for p in payloads)
    tracked = 2048
    got = {bytes.fromhex(r["gram_hex"]) for r in counts.heavy_hitters(wins, 200, tracked=tracked).collect()}
    # The sketch's map is the next power of two above 4/3 of the tracked items, at least.
    bound = 3.5 * total / tracked
    assert {g for g, c in brute(payloads, 4).items() if c > bound} <= got


def test_signed_sketch_error_and_merge(spark):
    rng = random.Random(5)
    entries = [(rng.randbytes(5), rng.choice([1, 1, 2, 5, 400])) for _ in range(2000)]
    table = count_table(spark, entries)
    slots = 1009
    sketch = counts.signed_sketch(table, slots)
    halves = [counts.signed_sketch(count_table(spark, entries[i::2]), slots) for i in range(2)]
    cells = {(r["seed_no"], r["slot"]): r["cell"] for r in sketch.collect() if r["cell"]}
    merged = {(r["seed_no"], r["slot"]): r["cell"] for r in counts.merge_signed(*halves).collect() if r["cell"]}
    assert cells == merged
    estimates = gram_dict(counts.estimate_signed(table, sketch, slots), "estimate")
    dense = counts.estimate_dense(table, counts.dense_sketch(sketch, slots), slots)
    assert gram_dict(dense, "estimate") == estimates
    spread = np.sqrt(sum(c * c for _, c in entries) / slots)
    errors = [abs(estimates[g] - c) for g, c in entries]
    assert np.mean([e <= 3 * spread for e in errors]) > 0.98


def test_distinct_estimate(payload_table):
    rng = random.Random(9)
    payloads = [rng.randbytes(3000) for _ in range(10)]
    sketches = counts.distinct_sketch(windows(payload_table(payloads), 5, keep=("doc_id",)), ("doc_id",))
    estimate = counts.merge_distinct(sketches).first()["distinct_grams"]
    assert estimate == pytest.approx(len(brute(payloads, 5)), rel=0.03)


def test_top_k_tables(spark):
    left = count_table(spark, [(b"a", 5), (b"b", 3), (b"c", 2)])
    right = count_table(spark, [(b"b", 9), (b"d", 1)])
    assert set(gram_dict(topk.only_left(left, right))) == {b"a", b"c"}
    assert gram_dict(topk.also_right(left, right)) == {b"b": 3}
    assert set(gram_dict(topk.only_left(right, left))) == {b"d"}
    row = topk.overlap(left, right).first()
    assert (row["left_size"], row["right_size"], row["common"], row["common_share"]) == (3, 2, 1, 0.5)
    assert [bytes(r["gram"]) for r in topk.gram_difference(right, left).collect()] == [b"d"]
    both = topk.duplicate_grams(left.unionByName(right))
    assert gram_dict(both, "copies") == {b"b": 2}
    ties = count_table(spark, [(b"z", 1), (b"y", -4), (b"x", 1), (b"w", 1)])
    assert [bytes(r["gram"]) for r in topk.top_grams(ties, 3).collect()] == [b"y", b"w", b"x"]
    assert set(gram_dict(topk.frequent(count_table(spark, [(b"a", 10), (b"b", 11)])))) == {b"b"}


def test_partial_counts_add_up_in_bounded_parts(spark):
    """Payloads longer than a part, short, empty and null ones; a part holds no more than its windows."""
    rng = random.Random(8)
    rows = [(tier, bytearray(rng.choices(b"\x00ab\xff", k=size))) for size in (0, 4, 5, 6, 40, 700) for tier in ("x", "y", None)]
    df = spark.createDataFrame([*rows, ("x", None)], "tier string, payload binary").repartition(3)
    exact = {(r["tier"], bytes(r["gram"])): r["cnt"] for r in counts.count_grams(df, 5, by=("tier",)).collect()}
    parts = counts.partial_counts(df, 5, by=("tier",), part_windows=64)
    merged = counts.merge_counts(parts, by=("tier",)).collect()
    assert {(r["tier"], bytes(r["gram"])): r["cnt"] for r in merged} == exact and len(merged) == len(exact)
    each = {(r["tier"], r["gram"]): r["count"] for r in counts.occurrences(parts).groupBy("tier", "gram").count().collect()}
    assert {(tier, bytes.fromhex(gram)): cnt for (tier, gram), cnt in each.items()} == exact
    for n in (1, 8):
        merged = counts.merge_counts(counts.partial_counts(df, n)).collect()
        assert {bytes(r["gram"]): r["cnt"] for r in merged} == {bytes(r["gram"]): r["cnt"] for r in counts.count_grams(df, n).collect()}


def test_least_and_greatest_windows_are_kept_without_a_sort(spark):
    from bytesieve.plans.gram_queries import byte_windows

    plan = byte_windows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


@pytest.mark.parametrize("n", [1, 5, 6, 8])
@pytest.mark.parametrize("max_wins", [None, 50])
def test_partial_counts_with_first_steps(spark, n, max_wins):
    """The first step of each gram comes with its counts, whatever the order and the parts in which payloads are read."""
    rng = random.Random(n)
    rows, start, expected, cnt = [], 0, {}, Counter()
    for size in [0, 4, 700, 5, 90, 8, 300, 60, 200]:
        payload = bytes(rng.choices(b"\x00ab\xff", k=size))
        rows.append((start, bytearray(payload)))
        for i in range(min(max(size - n + 1, 0), max_wins or size)):
            start += 1
            expected.setdefault(payload[i : i + n], start)
            cnt[payload[i : i + n]] += 1
    df = spark.createDataFrame([*rows[::-1], (start, None)], "before long, payload binary").coalesce(2)
    parts = counts.partial_counts(df, n, start="before", max_wins=max_wins, part_windows=64).collect()
    assert len(parts) > len(expected) or n == 8
    got, added = {}, Counter()
    for row in parts:
        gram = bytes(row["gram"])
        got[gram] = min(row["step"], got.get(gram, row["step"]))
        added[gram] += row["cnt"]
    assert got == expected and added == cnt
    whole = counts.partial_counts(df.coalesce(1), n, start="before", max_wins=max_wins).collect()
    assert {bytes(row["gram"]): (row["cnt"], row["step"]) for row in whole} == {gram: (cnt[gram], expected[gram]) for gram in cnt}
    assert len(whole) == len(cnt)


def test_possible_counts_lose_no_member(spark):
    rng = random.Random(5)
    payloads = [bytes(rng.choices(b"\x00ab\xff", k=size)) for size in (0, 4, 5, 700, 60)]
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)] + [(9, None)], "doc_id long, payload binary")
    members = {p[at : at + 5] for p in payloads for at in range(0, max(len(p) - 4, 0), 7)}
    vocab = count_table(spark, [(gram, 1) for gram in members] + [(b"ab", 1)])
    rows = counts.possible_counts(df, vocab, 5, "doc_id", slice_windows=64).collect()
    wins, hits = Counter(), Counter()
    for row in rows:
        if row["gram"] is None:
            wins[row["doc_id"]] += row["num_wins"]
        elif bytes(row["gram"]) in members:
            hits[row["doc_id"]] += row["cnt"]
    assert wins == {i: len(p) - 4 for i, p in enumerate(payloads) if len(p) > 4}
    assert hits == Counter(i for i, p in enumerate(payloads) for at in range(len(p) - 4) if p[at : at + 5] in members)
    assert sum(row["gram"] is not None for row in counts.possible_counts(df, vocab.where("false"), 5, "doc_id").collect()) == 0
