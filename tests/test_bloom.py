import random

import pytest
from pyspark.sql import functions as F

from bytesieve.functions.hashing import slots_of
from bytesieve.operators import bloom


def gram_table(spark, grams, **columns):
    df = spark.createDataFrame([(bytearray(g), i + 1) for i, g in enumerate(grams)], "gram binary, step long")
    return df


@pytest.fixture(scope="module")
def random_grams():
    rng = random.Random(21)
    return [rng.randbytes(5) for _ in range(3000)]


def test_no_false_negatives_and_fill(spark, random_grams):
    members, others = random_grams[:2000], random_grams[2000:]
    k, bits = 8, 2000 * 12
    table = gram_table(spark, members)
    bitmaps = bloom.build_bloom(table, k, bits)
    got = {bytes(r["gram"]): r["maybe"] for r in bloom.probe_bloom(gram_table(spark, random_grams), bitmaps, k, bits).collect()}
    assert all(got[g] for g in members)
    assert sum(got[g] for g in others) < 0.02 * len(others)
    positions = table.select(F.explode(slots_of(F.col("gram"), k, bits)).alias("p")).distinct().count()
    assert bloom.bits_set(bitmaps).first()["bits_set"] == positions


def test_union_of_filters(spark, random_grams):
    k, bits = 4, 100_003
    parts = [bloom.build_bloom(gram_table(spark, random_grams[i::2]), k, bits) for i in range(2)]
    whole = bloom.build_bloom(gram_table(spark, random_grams), k, bits)
    as_dict = lambda df: {r["bucket"]: bytes(r["bitmap"]) for r in df.collect()}
    assert as_dict(bloom.merge_blooms(*parts)) == as_dict(whole)


@pytest.mark.parametrize("bits", [4_001, 12_007])
def test_audit_equals_filling_in_order(spark, random_grams, bits):
    rng = random.Random(5)
    stream = [rng.choice(random_grams[:1500]) for _ in range(2500)]
    k = 4
    table = gram_table(spark, stream)
    slots = {
        bytes(r["gram"]): r["s"] for r in table.select("gram", slots_of(F.col("gram"), k, bits).alias("s")).collect()
    }
    seen, filled, no, ok, repeats = set(), set(), 0, 0, 0
    for g in stream:
        present = all(s in filled for s in slots[g])
        filled.update(slots[g])
        if g in seen:
            repeats += 1
            assert present
        elif present:
            no += 1
        else:
            ok += 1
        seen.add(g)
    packets = spark.range(17)
    row = bloom.audit_bloom(table, packets, k, bits).first()
    assert (row["add_ok"], row["add_no"], row["add_re"], row["repeats"]) == (ok, no, repeats, repeats)
    assert (row["packets"], row["ngrams"], row["distinct_grams"]) == (17, len(stream), len(seen))
    assert no > 0


def test_meta(spark, random_grams):
    vocab = gram_table(spark, random_grams).select(F.lit("gold").alias("tier"), F.lit(0).alias("generation"), "gram")
    row = bloom.bloom_meta(vocab, 10_000, 8).first()
    assert row["num_bits"] == bloom.bits_for(10_000, 8) == int(10_000 * 8 / 0.6931471805599453)
    assert row["n_added"] == row["add_ok"] + row["add_no"] == 3000
    assert row["error_rate"] == 1 / 256


@pytest.mark.parametrize("count", [1, 40, 2500])
def test_possible_rows_keep_all_members(spark, random_grams, count):
    members = random_grams[:count]
    table = gram_table(spark, random_grams)
    kept = {bytes(r["gram"]) for r in bloom.keep_possible(table, gram_table(spark, members)).collect()}
    assert set(members) <= kept
    assert len(kept) - count <= max(20, 0.12 * (len(random_grams) - count))


@pytest.mark.parametrize("max_rows", [8_192, 0])
def test_blocked_filter_equals_plain_blocks(spark, max_rows):
    """No member is missed; what else is found is what blocks of 512 bits, set one by one, call present."""
    rng = random.Random(5)
    draw = lambda count: list({rng.randbytes(5) for _ in range(count)})
    members, others = draw(3000), draw(6000)
    k, bits = 8, 60_000
    slots = lambda table: {
        bytes(r["gram"]): r["at"] for r in table.select("gram", bloom.blocked_slots(F.col("gram"), k, bits).alias("at")).collect()
    }
    table, asked = gram_table(spark, members), gram_table(spark, members + others)
    placed = slots(asked)
    assert all(len({at // 512 for at in ats}) == 1 and max(ats) < 118 * 512 for ats in placed.values())
    filled = {at for gram in members for at in placed[gram]}
    expected = {gram: all(at in filled for at in ats) for gram, ats in placed.items()}
    bitmaps = bloom.build_bloom(table, k, bits, blocked=True).persist()
    got = {bytes(r["gram"]): r["maybe"] for r in bloom.probe_blocked(asked, bitmaps, k, bits, max_rows=max_rows).collect()}
    assert got == expected and all(expected[gram] for gram in members)
    share = bloom.blocked_false_share(bitmaps, k, bits).first()["false_share"]
    false = sum(expected[gram] for gram in others if gram not in members)
    assert false == pytest.approx(share * len(others), abs=6 * (share * len(others)) ** 0.5 + 6)
    bitmaps.unpersist()
