"""Physical plans that the operators rely on at scale."""

import re

import pytest
from pyspark.sql import functions as F

from bytesieve.functions.headers import only_protocol, parse_frames
from bytesieve.operators import bloom, counts, flows, order, search, vocabulary
from bytesieve.plans.inputs import frames, passages, payloads, table

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()



@pytest.fixture
def docs(spark):
    return payloads(spark, SF_DIR)


def test_one_gram_shuffle_after_partial_counting(spark, docs):
    text = plan(counts.count_grams(docs, 5))
    gram = [line for line in text.splitlines() if "Exchange hashpartitioning(gram" in line]
    assert len(gram) == 1 and text.count("partial_count") == 1
    assert "struct<doc_id:bigint,text:string>" in text


def test_scan_reads_only_needed_columns(spark):
    read = table(spark, SF_DIR, "events").groupBy("user_id").count()
    assert "ReadSchema: struct<user_id:bigint>" in plan(read)


def test_screen_moves_no_window_with_a_small_vocabulary(spark, docs):
    bad = spark.createDataFrame([(bytearray(b"abcde"),)], "gram binary")
    text = plan(vocabulary.screen(docs, bad, 5))
    assert "BroadcastHashJoin" in text and "hashpartitioning(gram" not in text


def test_screen_makes_no_row_per_window(spark, docs):
    bad = spark.createDataFrame([(bytearray(b"abcde"),)], "gram binary")
    assert "Generate" not in plan(vocabulary.screen(docs, bad, 5))


def test_screen_counts_per_payload_before_a_shuffled_join(spark, docs):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        bad = spark.createDataFrame([(bytearray(b"abcde"),)], "gram binary")
        text = plan(vocabulary.screen(docs, bad, 5, max_rows=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    salted = re.search(r"hashpartitioning\(gram#\d+, _salt#\d+", text)
    counted = text.index("partial_count", salted.start())
    # Below the counting the filter is asked in place.
    assert text.index("BroadcastHashJoin", counted) > counted


def test_known_grams_are_dropped_after_counting(spark, docs):
    known = spark.createDataFrame([(bytearray(b"abcde"),)], "gram binary")
    text = plan(vocabulary.train_vocabulary(docs, 5, skip=(known,)))
    join = re.search(r"(BroadcastHash|SortMerge)Join[^\n]*LeftOuter", text)
    assert join and text.index("partial_count") > join.start()


def test_order_needs_no_one_task_window_on_grams(spark, docs):
    first = vocabulary.first_steps(order.stepped_windows(docs, 5, ["doc_id"]))
    text = plan(vocabulary.generations(first, 1000))
    # The only single-task window is over one row per range partition.
    for line in text.splitlines():
        if "SinglePartition" in line:
            below = text[text.index(line) :]
            assert re.search(r"Exchange hashpartitioning\(_part#", below)


def test_sightings_are_combined_before_each_shuffle(spark, docs):
    text = plan(order.sighting_steps(docs, 5, ["doc_id"]))
    assert "partial_min(step" in text
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning(gram" in line]
    assert len(exchanges) == 1


def test_bloom_shuffles_positions_once_and_builds_after(spark, docs):
    vocab = counts.count_grams(docs, 5).select("gram")
    text = plan(bloom.build_bloom(vocab, 8, 1_000_003))
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning(bucket" in line]
    assert len(exchanges) == 1
    assert text.index("bitmap_construct_agg") < text.index(exchanges[0])


def test_header_filters_do_not_copy_the_parser(spark):
    parsed = only_protocol(parse_frames(frames(spark, SF_DIR)), 6)
    text = plan(parsed.groupBy("proto").count())
    assert len(text) < 60_000


def test_passages_are_broadcast_and_windows_stay(spark, docs):
    text = plan(search.find_passages(docs.select("doc_id", "payload"), passages(spark, SF_DIR)))
    assert text.count("BroadcastHashJoin") >= 2
    assert "hashpartitioning(_prefix" not in text.split("BroadcastExchange")[0]


def test_flow_chunks_are_grouped_by_bounded_chunk(spark):
    packets = only_protocol(parse_frames(frames(spark, SF_DIR)), 6)
    text = plan(flows.flow_buffers(packets))
    groups = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert "chunk_no" in groups[0]


def test_counting_texts_needs_no_labels(spark):
    from bytesieve.plans.registry import QUERIES
    import bytesieve.plans.gram_queries  # noqa: F401

    df = QUERIES["exact_counts"](spark, "/root/testdata/sf0.001")
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_blocked_probe_and_dense_estimates_move_no_gram(spark):
    grams = spark.createDataFrame([(bytearray(b"abcde"), 2), (bytearray(b"fghij"), 3)], "gram binary, cnt long")
    bitmaps = spark.createDataFrame(bloom.build_bloom(grams, 8, 100_000, blocked=True).collect(), "bucket long, bitmap binary")
    text = plan(bloom.probe_blocked(grams, bitmaps, 8, 100_000))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text and "Generate" not in text
    pages = spark.createDataFrame(counts.dense_sketch(counts.signed_sketch(grams, 9_973), 9_973).collect(), "seed_no int, page int, cells array<long>")
    text = plan(counts.estimate_dense(grams, pages, 9_973))
    assert text.count("BroadcastHashJoin") == 5 and "hashpartitioning" not in text and "Generate" not in text
