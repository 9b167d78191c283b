import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bytesieve.llm import lm
from bytesieve.llm.common import word_hashes
from bytesieve.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), "\n"]


def test_base_scores_equal_plain_python_and_the_model_is_better(spark, small_documents):
    rows = {r["doc_id"]: r for r in QUERIES["op6_lm_score"](spark, SMALL).collect()}
    texts = {r["doc_id"]: r["text"] for r in small_documents.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    counts = Counter(t for d, text in texts.items() if not held[d] for t in tokens(text))
    total, size = sum(counts.values()), len(counts)
    assert set(rows) == set(texts)
    for d, text in texts.items():
        said = tokens(text)
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (size + 1))) for t in said)
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[d], len(said), total)
        assert r["n_known"] == sum(counts[t] > 0 for t in said)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    out = [rows[d] for d in texts if held[d]]
    assert sum(r["score"] for r in out) > 0.97 * sum(r["base_score"] for r in out)


def test_rare_words_come_by_the_join(spark, small_documents):
    part = small_documents.limit(200).persist()
    few = {r["doc_id"]: r for r in lm.score_texts(part, part, head=50).collect()}
    many = {r["doc_id"]: r for r in lm.score_texts(part, part).collect()}
    for d, r in many.items():
        assert few[d]["n_known"] == r["n_known"] and few[d]["base_score"] == pytest.approx(r["base_score"])


def test_the_model_is_a_distribution(spark, small_documents):
    """Over all words seen and one unseen word for each class, the chances after any context add up to one."""
    part = small_documents.limit(100)
    counts = lm.count_words(part)
    lexicon = lm.lexicon_of(counts)
    sums, words = lm.class_totals(counts, lexicon)
    table = counts.toArrow()
    of = lexicon.classes(pa.array(table["word"].to_pylist()))
    inside = np.bincount(of, table["c"].to_numpy() + 0.5, lm.CLASSES) + 0.5
    assert np.allclose(inside / (sums + 0.5 * (words + 1)), 1)
    weights = lm.train_classes(part, lexicon)
    features = lm.Tokens(pa.array(["one two three", "", None]), lexicon).features
    assert features.shape == (3, 6)
    assert np.allclose(np.exp(lm.class_scores(weights, features)).sum(1), 1, atol=1e-4)


def test_training_again_gives_the_same_model(spark, small_documents):
    part = small_documents.limit(100).repartition(5, "doc_id")
    lexicon = lm.lexicon_of(lm.count_words(part))
    assert np.allclose(lm.train_classes(part, lexicon), lm.train_classes(part, lexicon), atol=1e-5)


def test_hashes_cover_whole_words_of_any_length():
    long = "ab" * 4_000_000
    hashes = word_hashes(pa.array([long + "a", long + "b", "é", "e", long + "a", ""]))
    assert len(set(hashes[[0, 1, 2, 3, 5]].tolist())) == 5 and hashes[0] == hashes[4]
    assert len(word_hashes(pa.array([], pa.string()))) == 0


def test_odd_rows_and_empty_training(odd, nothing):
    rows = lm.score_texts(odd, odd).collect()
    assert len(rows) == 11 and all(r["n_known"] == r["n_tokens"] for r in rows)
    assert sorted(r["n_tokens"] for r in rows)[:5] == [1, 1, 1, 1, 2]
    unknown = lm.score_texts(odd, nothing).collect()
    assert len(unknown) == 11 and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] <= 0 for r in unknown)
    assert lm.score_texts(nothing, odd).collect() == []


def test_weights_do_not_depend_on_how_rows_are_placed(spark, small_documents, monkeypatch):
    monkeypatch.setattr(lm, "TASK_TOKENS", 60_000)
    texts = small_documents.select("doc_id", "text").persist()
    lexicon = lm.lexicon_of(lm.count_words(texts))
    assert lexicon.tokens > 3 * lm.TASK_TOKENS
    found = [lm.train_classes(texts.repartition(n, F.rand(n)), lexicon) for n in (1, 7)]
    assert np.abs(found[0]).max() > 1 and np.allclose(found[0], found[1], atol=1e-5)
    texts.unpersist()


def test_slices_follow_the_rows_of_a_shard_alone():
    rng = np.random.default_rng(3)
    rows = [("x" * int(rng.integers(0, 30)), shard) for shard in (2, 3, 7) for _ in range(40)]
    found = []
    for size in (1, 7, 33, 1000):
        batches = [
            pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows[i : i + size]], pa.string()), pa.array([r[1] for r in rows[i : i + size]])], ["text", "shard"]
            )
            for i in range(0, len(rows), size)
        ]
        found.append([(shard, texts.to_pylist()) for shard, texts in lm.shard_slices(iter(batches), 100)])
    assert all(f == found[0] for f in found) and [t for _, texts in found[0] for t in texts] == [r[0] for r in rows]
    assert all(sum(map(len, texts[:-1])) < 100 for _, texts in found[0])
