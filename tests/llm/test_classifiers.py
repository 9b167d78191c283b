import numpy as np
import pyarrow as pa

from bytesieve.llm import quality, toxicity
from bytesieve.llm.common import fold
from bytesieve.llm.queries import QUERIES

BIG = "/root/testdata/sf0.1"


def test_quality_on_held_out_documents(spark):
    scored = QUERIES["op3_quality"](spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").where("held_out")
    rows = scored.collect()
    assert len(rows) > 500 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.98
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 1]) > 0.99


def test_toxicity_on_held_out_documents(spark):
    scored = QUERIES["op8_toxicity"](spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").where("held_out")
    rows = scored.collect()
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 1]) > 0.8
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 0]) < 0.02


def test_labels_of_held_out_rows_change_nothing(spark, small_documents):
    table = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = table.withColumn("quality", (table.quality + (fold() == 0).cast("int")) % 2)
    a, b = quality.train(small_documents, table), quality.train(small_documents, flipped)
    assert all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables, strict=True))


def test_pairs_are_learned():
    rng = np.random.default_rng(0)
    rows = rng.random((4000, len(quality.FEATURES)))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(float)
    model = quality.fit(rows, labels)
    assert (0, 1) in {(a, b) for a, b, _ in model.pairs}
    assert (((model.score(rows) > 0.5) == labels).mean()) > 0.9


def test_classifiers_without_labels_or_with_one_class(spark, odd, nothing, labels):
    none = labels.limit(0)
    for table in (none, labels, labels.where("quality = 1")):
        model = quality.train(odd, table)
        rows = quality.score(odd, model).collect()
        assert len(rows) == 11 and all(0 < r["score"] < 1 for r in rows)
        assert quality.score(nothing, model).count() == 0
        detector = toxicity.train(odd, table)
        rows = toxicity.score(odd, detector).collect()
        assert len(rows) == 11 and all(0 < r["score"] < 1 for r in rows)
        assert toxicity.score(nothing, detector).count() == 0
    assert quality.train(nothing, labels).score(np.zeros((1, len(quality.FEATURES)))).shape == (1,)
    kept = quality.keep_good(odd, quality.train(odd, labels.where("quality = 1")))
    assert kept.columns == odd.columns and kept.count() == 11


def test_negative_risk_stays_non_negative():
    """With a prior above the true share, plain subtraction would push scores of all unlabelled texts to zero."""
    rng = np.random.default_rng(1)
    positive = np.arange(600) < 200
    toxic = positive | (rng.random(600) < 0.1)
    row = np.flatnonzero(toxic)
    detector = toxicity.fit(row, np.full(len(row), 7), positive, 0.3)
    assert detector.weights[0] > 1
    words = toxicity.word_columns(pa.array(["idiot", "idiot###", "12", "ïdiot"]))
    assert words[0] == words[1] and words[2] == -1 and words[3] not in (words[0], -1)


def test_labels_of_absent_documents_use_up_no_sample(spark, small_documents):
    """Far more labels of other documents than the sample holds change neither model."""
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality", "toxic")
    foreign = spark.range(10_000_000, 10_020_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "1 AS toxic")
    labels = known.selectExpr("doc_id", "CAST(quality AS INT) AS quality", "CAST(toxic AS INT) AS toxic")
    some = small_documents.limit(50)
    for module in (quality, toxicity):
        scores = [
            {r["doc_id"]: r["score"] for r in module.score(some, module.train(small_documents, given, sample_rows=600)).collect()}
            for given in (labels, labels.unionByName(foreign))
        ]
        assert scores[0] == scores[1] and len(set(scores[0].values())) > 5
