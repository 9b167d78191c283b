import random
import re

import numpy as np
import xxhash

from bytesieve.llm import simhash
from bytesieve.llm.common import components


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(1000, 1400)] + [(5, i) for i in range(2000, 2300)] + [(1, 1), (2, 1)]
    links += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(260)]
    names = list(range(1000, 1401))
    rng.shuffle(names)
    links += [(10_000 + names[i], 10_000 + names[i + 1]) for i in range(400)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == smallest_reachable(nodes, links)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_fingerprints_and_components_equal_brute_force(spark, small_documents):
    rows = simhash.near_duplicates(small_documents).collect()
    texts = {r["doc_id"]: r["text"] for r in small_documents.collect()}
    prints = {r["doc_id"]: r["fp"] % (1 << 64) for r in rows}
    for doc in sorted(texts)[:150]:
        assert prints[doc] == plain_fingerprint(texts[doc])
    ids = sorted(prints)
    fps = np.array([prints[i] for i in ids], dtype=np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    expected = smallest_reachable(ids, [(ids[a], ids[b]) for a, b in near])
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected


def test_pairs_within_a_radius():
    rng = np.random.default_rng(5)
    fps = np.unique(rng.choice(2**12, 700).astype(np.uint64) << np.uint64(30))
    for radius in (1, 2, 3, 4, 7):
        a, b = simhash.close_pairs(fps, radius)
        expected = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius, 1))
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == {tuple(p) for p in expected.tolist()}


def test_large_groups_are_cut_into_tiles(spark):
    rng = np.random.default_rng(6)
    fps = np.unique(rng.choice(2**16, 3000).astype(np.int64) << 3)
    table = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fps)], "id long, fp long")
    links = simhash.link_fingerprints(table, 2, tile=100)
    got = {r["node"]: r["component"] for r in components(links).collect()}
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    expected = smallest_reachable(range(len(fps)), near.tolist())
    assert {n: got.get(n, n) for n in range(len(fps))} == expected


def test_odd_rows(odd, nothing):
    rows = sorted(simhash.near_duplicates(odd).collect(), key=repr)
    found = {(r["doc_id"], r["component_id"]) for r in rows}
    assert len(rows) == 11
    assert found == {(1, 1), (2, 2), (3, 2), (4, 2), (5, 5), (None, None), (7, 1), (8, 8), (9, 9)}
    assert next(r for r in rows if r["doc_id"] == 3)["fp"] == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 2, 5, 8, 9]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_first(nothing).count() == 0


def test_first_of_copies_with_columns_that_have_no_order(spark):
    """Repeated ids, a map column and a column named like the operator's own."""
    frame = spark.sql(
        "SELECT * FROM VALUES (1L, 'a b c d', map('x', 1), 7L), (1L, 'a b c d', map('y', 2), 8L), (2L, 'a b c d', map('x', 1), 9L), "
        "(CAST(NULL AS LONG), 'a b c d', map('z', 1), 9L) AS t(doc_id, text, extra, _kept_id)"
    )
    kept = simhash.keep_first(frame)
    assert kept.columns == frame.columns
    rows = kept.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "None"]
    assert [(r["extra"], r["_kept_id"]) for r in rows if r["doc_id"] == 1][0] in (({"x": 1}, 7), ({"y": 2}, 8))
