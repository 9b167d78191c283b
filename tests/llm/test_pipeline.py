import corpus_pipeline
from bytesieve.llm import quality, secrets, simhash
from bytesieve.session import materialize

SMALL = "/root/testdata/sf0.01"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect_on_what_was_kept(spark, small_documents):
    docs, seen = small_documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SMALL), f"test-{name}")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == NAMES
    before, after = seen["quality"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = before.join(labels.where("quality = 1"), "doc_id", "left_semi").count()
    bad = before.join(labels.where("quality = 0"), "doc_id", "left_semi").count()
    assert after.join(labels.where("quality = 1"), "doc_id", "left_semi").count() >= 0.98 * good
    assert after.join(labels.where("quality = 0"), "doc_id", "left_semi").count() <= 0.2 * bad
    before, after = seen["near_duplicates"]
    groups = simhash.near_duplicates(before).select("component_id").distinct().count()
    assert after.count() == groups < before.count()
    before, after = seen["secrets"]
    assert after.count() == before.count() and after.where("contains(text, '[SECRET]')").count() > 0
    assert secrets.find_secrets(after).where("size(spans) > 0").count() == 0
    before, after = seen["mixing"]
    assert after.join(before, NAMES, "left_anti").count() == 0
    before, after = seen["packing"]
    assert after.where("piece = 0").count() == before.count()


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns[:3] == ["doc_id", "piece", "start"] and rows.count() > 100


def test_stages_on_odd_and_empty_tables(spark, odd, nothing):
    for table in (odd, nothing):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SMALL), f"test-odd-{name}")
            assert name == "packing" or docs.columns == table.columns
    assert quality.THRESHOLD == 0.3
