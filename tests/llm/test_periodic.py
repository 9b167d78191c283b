import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from bytesieve.llm import periodic, queries


def smallest_period(words):
    """By the longest border of the words (Knuth, Morris, Pratt)."""
    borders = [0]
    for i in range(1, len(words)):
        k = borders[-1]
        while k and words[i] != words[k]:
            k = borders[k - 1]
        borders.append(k + (words[i] == words[k]))
    return len(words) - borders[-1]


def brute_runs(words):
    """Runs as defined: every lag walked over the whole text."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            run = words[i : j + q]
            if len(run) >= max(24, 3 * q) and smallest_period(run) == q:
                found.append((i, len(run), q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng):
    kind = rng.randrange(7)
    unit = [rng.randrange(4) for _ in range(rng.randrange(1, 50))]
    if kind == 0:
        return [rng.randrange(2) for _ in range(rng.randrange(200))]
    if kind == 1:
        return [0] * rng.randrange(100)
    if kind == 2:
        return unit * rng.randrange(1, 8) + [rng.randrange(3) for _ in range(5)] + unit * 3
    if kind == 3:
        # Every gram of a period comes back within the period.
        a, b = ([rng.randrange(5) for _ in range(20)] for _ in range(2))
        return (a + a + a + b + b + b + a + b) * rng.randrange(1, 5)
    if kind == 4:
        short = [unit[: rng.randrange(1, 9)] * rng.randrange(1, 12) for _ in range(4)]
        return sum(short, []) * rng.randrange(1, 4)
    if kind == 5:
        a, b = [0], [0, 1]
        for _ in range(11):
            a, b = b, b + a
        return b[: rng.randrange(300)]
    words = [rng.randrange(100) for _ in range(rng.randrange(16, 80))] * 4
    words[rng.randrange(len(words))] = 101
    return words


def coded(texts):
    codes = np.array([word for text in texts for word in text], np.int32)
    return codes, np.cumsum([0, *map(len, texts)])


def found_runs(texts, finder=periodic.find_runs):
    codes, offsets = coded(texts)
    runs = [[] for _ in texts]
    for start, length, period in zip(*map(np.ndarray.tolist, finder(codes, offsets)), strict=True):
        text = int(np.searchsorted(offsets, start, side="right")) - 1
        runs[text].append((start - int(offsets[text]), length, period))
    return runs


def test_runs_equal_brute_force():
    rng = random.Random(5)
    texts = [random_words(rng) for _ in range(300)]
    expected = [brute_runs(text) for text in texts]
    assert sum(map(len, expected)) > 300
    assert found_runs(texts) == expected


def test_colliding_hashes_are_noticed(monkeypatch):
    """With hashes of a few bits a text either raises or has its true runs."""
    rng = random.Random(6)
    mixed = periodic._mixed
    monkeypatch.setattr(periodic, "_mixed", lambda values: mixed(values) & np.uint64(1023))
    raised = 0
    for text in (random_words(rng) for _ in range(60)):
        try:
            got = found_runs([text], lambda codes, offsets: periodic._extended(codes, offsets, 0))
        except periodic.Collision:
            raised += 1
        else:
            assert got == [brute_runs(text)]
    assert 3 < raised < 57


def test_long_repetitive_texts_take_little_time():
    rng = np.random.default_rng(1)
    began = time.perf_counter()
    for unit, times in ((1, 300_000), (777, 400), (100_000, 3)):
        words = np.tile(rng.integers(0, 50, unit).astype(np.int32), times)
        starts, lengths, periods = periodic.find_runs(words, np.array([0, len(words)]))
        assert len(words) in lengths and unit in periods
    assert time.perf_counter() - began < 20


def expected_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(word for i, word in enumerate(words) if i not in dropped)
    best = (None,) * 4
    if runs:
        # max keeps the first of equals, and runs are by start, then period.
        top = runs[0]
        for run in runs[1:]:
            if run[1] * top[2] > top[1] * run[2]:
                top = run
        best = (*top, 1000 * top[1] // top[2])
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{word}" for word in random_words(rng))) for i in range(150)]
    rows += [(i, " \t".join(str(rng.randrange(30)) for _ in range(rng.randrange(120)))) for i in range(150, 300)]
    rows += [(300, "Wort  Wort\n" * 40), (300, "Wort  Wort\n" * 40), (None, "a b " * 30), (None, None), (301, ""), (302, " \n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((expected_row(*row) for row in rows), key=repr)
    assert sum(row[1] > 0 for row in got) > 30


def test_odd_rows(odd, nothing):
    rows = periodic.periodic_runs(odd).collect()
    assert len(rows) == odd.count()
    long = next(r for r in rows if r["doc_id"] == 5)
    assert [tuple(run) for run in long["runs"]] == [(0, 60_000, 1)] and long["collapsed"] == "word"
    assert all(r["collapsed"] == "" and r["runs"] == [] for r in rows if r["doc_id"] in (2, 3, 4))
    assert periodic.periodic_runs(nothing).collect() == []


@pytest.mark.parametrize("draw", [None, "CAST(NULL AS LONG)", "group + 1"])
def test_texts_without_a_draw_stay(odd, draw):
    rows = periodic.periodic_runs(odd.where("doc_id = 9"), draw).collect()
    assert [(r["n_words"], r["collapsed"]) for r in rows] == [(1, "x")]
