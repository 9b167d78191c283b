import random

import pytest
from pyspark.sql import functions as F

from bytesieve.operators import order


def test_global_rank_of_string_and_number(spark):
    rng = random.Random(2)
    keys = [(rng.choice("abc"), i) for i in rng.sample(range(10**6), 3000)]
    df = spark.createDataFrame(keys, "f string, n long").repartition(13)
    ranks = {(r["f"], r["n"]): r["rank"] for r in order.global_rank(df, ["f", "n"]).collect()}
    assert ranks == {key: i + 1 for i, key in enumerate(sorted(keys))}


def test_running_total_with_one_hot_group(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abcd"), i, rng.randrange(9)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, n long, v long").repartition(11)
    got = {(r["k"], r["n"]): r["before"] for r in order.running_total(df, {"v": "before"}, ["n"], ("k",)).collect()}
    expected, sums = {}, {}
    for k, n, v in rows:
        expected[k, n] = sums.get(k, 0)
        sums[k] = expected[k, n] + v
    assert got == expected


def test_steps_follow_reading_order(payload_table):
    payloads = [b"abcdefg", b"xy", b"abcab", b"hello world"]
    got = order.stepped_windows(payload_table(payloads), 3, ["doc_id"])
    expected = [p[i : i + 3] for p in payloads for i in range(len(p) - 2)]
    assert [bytes(r["gram"]) for r in got.orderBy("step").collect()] == expected
    assert [r["step"] for r in got.orderBy("step").collect()] == list(range(1, len(expected) + 1))


@pytest.mark.parametrize("n", [3, 9])
@pytest.mark.parametrize("max_wins", [None, 6])
def test_counts_and_first_steps_in_one_pass(payload_table, n, max_wins):
    rng = random.Random(n)
    payloads = [bytes(rng.choices(b"ab", k=rng.randrange(30))) for _ in range(50)]
    rows = order.counted_steps(payload_table(payloads).repartition(5), n, ["doc_id"], max_wins=max_wins).collect()
    expected, step = {}, 0
    for p in payloads:
        for i in range(min(max(len(p) - n + 1, 0), max_wins or len(p))):
            step += 1
            gram = p[i : i + n]
            first, cnt = expected.get(gram, (step, 0))
            expected[gram] = (first, cnt + 1)
    assert {bytes(r["gram"]): (r["step"], r["cnt"]) for r in rows} == expected and len(rows) == len(expected)


def test_training_curve_against_loop(payload_table):
    rng = random.Random(8)
    payloads = [bytes(rng.choices(b"abcdef", k=40)) for _ in range(30)]
    curve = order.training_curve(payload_table(payloads), 4, ["doc_id"], every=100)
    got = [tuple(r)[:3] for r in curve.orderBy("ngrams").collect()]
    expected, seen, step = [], {}, 0
    for p in payloads:
        for i in range(len(p) - 3):
            step += 1
            seen[p[i : i + 4]] = seen.get(p[i : i + 4], 0) + 1
            if step % 100 == 0:
                expected.append((step, sum(c >= 2 for c in seen.values()), len(seen)))
    assert got == expected and len(got) == 11


@pytest.mark.parametrize("slice_bytes", [1 << 20, 7])
def test_sightings_against_loop(payload_table, slice_bytes):
    rng = random.Random(12)
    payloads = [bytes(rng.choices(b"abcd", k=rng.randrange(60))) for _ in range(40)] + [b"a" * 90]
    got = order.sighting_steps(payload_table(payloads), 4, ["doc_id"], slice_bytes=slice_bytes)
    seen, expected, step = {}, [], 0
    for p in payloads:
        for i in range(len(p) - 3):
            step += 1
            seen[p[i : i + 4]] = seen.get(p[i : i + 4], 0) + 1
            if seen[p[i : i + 4]] <= 2:
                expected.append((seen[p[i : i + 4]], step))
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_saturation_step(spark):
    df = spark.createDataFrame(list(enumerate("xxyxz")), "n long, k string")
    assert [r["step"] for r in order.saturation_step(df, "k", "n", 2).collect()] == [5]
    assert order.saturation_step(df, "k", "n", 3).collect() == []


@pytest.mark.parametrize("budget,kept", [(5, [0, 1]), (0, [0, 1, 2]), (3, [0, 1]), (2, [0]), (100, [0, 1, 2])])
def test_budget(payload_table, budget, kept):
    lines = payload_table([b"abcdef", b"ghijkl", b"mnopqr", b"xyz"])
    got = order.within_budget(lines, 4, budget, ["doc_id"], min_bytes=5)
    assert sorted(r["doc_id"] for r in got.collect()) == kept
