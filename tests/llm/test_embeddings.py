import numpy as np
import pytest

from bytesieve.llm import embeddings
from tests.llm.test_simhash import smallest_reachable


def brute(ids, vectors, cosine=0.9):
    rows = embeddings.unit(np.array(vectors))
    near = rows @ rows.T >= cosine
    np.fill_diagonal(near, False)
    links = [(ids[a], ids[b]) for a, b in np.argwhere(np.triu(near, 1))]
    return dict(zip(ids, near.sum(1).tolist(), strict=True)), smallest_reachable(ids, links), len(links)


def test_small_table_equals_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.collect()
    links, roots, _ = brute([r["vec_id"] for r in rows], [r["embedding"] for r in rows])
    got = embeddings.near_vectors(table, cell=64).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == links
    assert {r["vec_id"]: r["component_id"] for r in got} == roots
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_recall_at_the_threshold_with_a_hot_group(spark):
    """Pairs spread around the threshold, equal vectors, and a third of all rows within one cell."""
    rng = np.random.default_rng(2)
    base = embeddings.unit(rng.standard_normal((300, 32)))
    near = embeddings.unit(base + rng.standard_normal((300, 32)) * 0.08)
    hot = embeddings.unit(base[:1] + rng.standard_normal((400, 32)) * 0.06)
    vectors = np.concatenate([base, near, hot, np.repeat(base[5:6], 40, axis=0)])
    ids = list(range(len(vectors)))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    links, _, total = brute(ids, vectors)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(table, cell=32).collect()}
    assert all(got[i] <= links[i] for i in ids)
    assert sum(got.values()) >= 0.98 * 2 * total


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [float("nan"), 1.0], 0),
        (6, [1.0, None], 0), (7, [float("inf"), 0.0], 0), (8, [1.0, 0.0, 0.0], 0), (9, [], 0), (None, [1.0, 0.0], 0), (10, [1e300, 1e299], 0),
        (11, [-1.0, 0.0], 0),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(table).collect()}
    lone = {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11)}
    assert got == lone | {1: (2, 1, True), 2: (2, 1, False), 10: (2, 1, False), None: (0, None, True)}
    assert embeddings.near_vectors(table.limit(0)).collect() == []


@pytest.mark.parametrize("vectors", [10, 10_000, 1_000_000])
def test_plan_keeps_recall(vectors):
    plan = embeddings.Plan.of(vectors)
    together = (1 - np.arccos(0.9) / np.pi) ** plan.bits
    assert 1 - (1 - together) ** plan.tables >= 0.998 and 20 <= plan.collisions <= embeddings.LINES
