import random

import pytest

from bytesieve.operators.search import find_passages


@pytest.mark.parametrize("max_rows", [500_000, 0])
def test_all_pairs_against_find(spark, max_rows):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcé ", k=rng.randrange(1, 9)))
    stem = "a shared beginning of many patterns "
    patterns = [stem + word() * 4 for _ in range(25)] + [word() for _ in range(6)] + ["é", "", stem, stem]
    texts = []
    for _ in range(60):
        parts = [word() * 3 for _ in range(10)] + rng.choices(patterns, k=4)
        rng.shuffle(parts)
        texts.append("".join(parts))
    texts += ["", stem * 3]
    docs = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "doc_id long, payload binary")
    needles = spark.createDataFrame(
        [(i, bytearray(p.encode())) for i, p in enumerate(patterns)], "item_id long, payload binary"
    )
    got = {(r["doc_id"], r["item_id"], r["position"]) for r in find_passages(docs, needles, max_rows=max_rows).collect()}
    expected = {
        (d, i, t.encode().find(p.encode()))
        for d, t in enumerate(texts)
        for i, p in enumerate(patterns)
        if p and p in t
    }
    assert got == expected


def test_no_patterns(spark):
    docs = spark.createDataFrame([(1, bytearray(b"abc"))], "doc_id long, payload binary")
    none = spark.createDataFrame([], "item_id long, payload binary")
    assert find_passages(docs, none).collect() == []
