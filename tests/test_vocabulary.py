import random
from collections import Counter

import pytest
from helpers import gram_dict
from pyspark.sql import functions as F

from bytesieve.operators import counts, vocabulary
from bytesieve.plans.inputs import payloads as tiered_payloads
from bytesieve.sources.payloads import LINE_ORDER, hex_lines


def grams_of(p, n, cap=None):
    return [p[i : i + n] for i in range(min(max(len(p) - n + 1, 0), cap or 10**9))]


def vocab(spark, grams):
    return spark.createDataFrame([(bytearray(g),) for g in grams], "gram binary")


BAD = b"EVIL!"


def with_windows(count, hits, at=0):
    """A payload of ``count`` five-byte windows of which ``hits`` are bad."""
    body = bytearray((i * 7 + 1) % 100 for i in range(count + 4))
    for h in range(hits):
        body[at + 5 * h : at + 5 * h + 5] = BAD
    return bytes(body)


@pytest.mark.parametrize("max_rows", [500_000, 0])
def test_deny_rule(spark, payload_table, max_rows):
    cases = [
        (with_windows(19, 1), True),
        (with_windows(20, 1), False),
        (with_windows(20, 2), True),
        (with_windows(150, 8, at=110), True),
        (with_windows(150, 7, at=110), False),
        (with_windows(30, 0), False),
    ]
    table = payload_table([p for p, _ in cases] + [b"abc"])
    rows = vocabulary.screen(table, vocab(spark, [BAD]), 5, max_rows=max_rows).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(got) == len(cases)
    for i, (p, denied) in enumerate(cases):
        assert got[i]["num_wins"] == len(p) - 4
        assert got[i]["hits"] == grams_of(p, 5).count(BAD)
        assert got[i]["denied"] == denied


@pytest.mark.parametrize("n", [5, 9])
def test_screen_of_repeated_ids_and_odd_payloads(spark, n):
    """Rows of one id count together; null and short payloads give no verdict; a gram of another length hits nothing."""
    rng = random.Random(n)
    rows = [(i % 9 or None, bytes(rng.choices(b"abc", k=rng.randrange(60)))) for i in range(40)]
    bad = {p[at : at + n] for _, p in rows for at in range(0, max(len(p) - n + 1, 0), 11)}
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in rows] + [(77, None), (78, b"ab")], "doc_id long, payload binary")
    got = {r["doc_id"]: r for r in vocabulary.screen(df.repartition(4), vocab(spark, [*bad, b"ab"]), n).collect()}
    wins, hits = Counter(), Counter()
    for i, p in rows:
        wins[i] += max(len(p) - n + 1, 0)
        hits[i] += sum(g in bad for g in grams_of(p, n))
    assert {i: (r["num_wins"], r["hits"]) for i, r in got.items()} == {i: (w, hits[i]) for i, w in wins.items() if w}
    assert all(r["denied"] == (r["hits"] > r["num_wins"] // 20) for r in got.values())


def train_by_hand(payloads, n, cap=None):
    gold = Counter(g for t, p in payloads if t == "gold" for g in grams_of(p, n, cap))
    bad = Counter(g for t, p in payloads if t == "bad" for g in grams_of(p, n, cap) if g not in gold)
    normal = Counter()
    for t, p in payloads:
        if t != "normal" or len(p) < n:
            continue
        wins = grams_of(p, n)
        if sum(g in bad for g in wins) > int(0.05 * len(wins)):
            continue
        normal.update(g for g in grams_of(p, n, cap) if g not in bad)
    return {"gold": gold, "bad": bad, "normal": normal}


@pytest.mark.parametrize("cap", [None, 40])
def test_tiers_against_plain_loops(spark, cap):
    rng = random.Random(11)
    words = [rng.randbytes(6) for _ in range(60)]
    rows = []
    for _ in range(120):
        tier = rng.choice(["gold", "bad", "normal", "normal"])
        pool = {"gold": words[:30], "bad": words[20:40], "normal": words[:60]}[tier]
        weights = [6 if w in words[:20] else 1 for w in pool]
        rows.append((tier, b"".join(rng.choices(pool, weights, k=rng.randrange(1, 30)))))
    df = spark.createDataFrame(
        [(i, t, bytearray(p)) for i, (t, p) in enumerate(rows)], "doc_id long, tier string, payload binary"
    )
    expected = train_by_hand(rows, 5, cap)
    trained = vocabulary.train_tiers(df, 5, max_wins=cap)
    for tier, table in trained.items():
        assert gram_dict(table) == expected[tier], tier
    assert expected["normal"] and expected["bad"]


@pytest.mark.parametrize(
    "sf,gold,bad,normal,windows",
    [("0.001", 4534, 764, 6840, 11016), ("0.01", 14690, 1873, 21630, 53331)],
)
def test_hundred_window_setting(spark, sf, gold, bad, normal, windows):
    trained = vocabulary.train_tiers(tiered_payloads(spark, f"/root/testdata/sf{sf}"), 5, max_wins=100)
    row = trained["normal"].agg(F.count("*").alias("n"), F.sum("cnt").alias("w")).first()
    assert trained["gold"].count() == gold
    assert trained["bad"].count() == bad
    assert (row["n"], row["w"]) == (normal, windows)


def test_published_normal_grams_are_skipped(spark, payload_table):
    table = payload_table([b"abcdefgh" * 4])
    bad, old = vocab(spark, [BAD]), vocab(spark, [b"abcde", b"bcdef"])
    got = gram_dict(vocabulary.train_normal(table, bad, 5, published=old))
    assert b"abcde" not in got and b"bcdef" not in got and got[b"cdefg"] == 4


def test_run_counters(spark):
    table = spark.createDataFrame(
        [(bytearray(b"a"), 1), (bytearray(b"b"), 2), (bytearray(b"c"), 5), (bytearray(b"s"), 4)], "gram binary, cnt long"
    )
    row = vocabulary.training_counters(table.where(F.col("gram") != b"s")).first()
    assert row.asDict() == {"ngrams": 8, "add_skipped": 0, "add_tmp_ok": 3, "add_ok": 2, "add_fail": 3}
    row = vocabulary.training_counters(table, vocab(spark, [b"s", b"zz"])).first()
    assert (row["ngrams"], row["add_skipped"]) == (12, 4)
    assert row["ngrams"] == row["add_skipped"] + row["add_tmp_ok"] + row["add_ok"] + row["add_fail"]
    kept = vocabulary.second_sightings(table)
    assert set(gram_dict(kept)) == {b"b", b"c", b"s"}


def test_list_counters_count_across_generations(spark, payload_table):
    df = counts.count_grams(payload_table([b"aaaaab", b"aaaab"], "gold"), 3, by=("tier",))
    row = vocabulary.list_counters(df).first()
    assert (row["add_ok"], row["add_in"]) == (2, 5)


def test_generations(spark):
    first = spark.createDataFrame([(bytearray([i]), (i * 37) % 101) for i in range(50)], "gram binary, step long")
    got = gram_dict(vocabulary.generations(first, 20, published=3), "generation")
    in_order = sorted(range(50), key=lambda i: (i * 37) % 101)
    assert got == {bytes([g]): 3 + rank // 20 for rank, g in enumerate(in_order)}


def test_tiers_from_files(spark, tmp_path):
    rng = random.Random(41)
    words = [rng.randbytes(7) for _ in range(30)]
    rows, lines = [], None
    for tier, pool in (("gold", words[:15]), ("bad", words[10:20]), ("normal", words)):
        (tmp_path / tier).mkdir()
        for number in range(3):
            texts = [b"".join(rng.choices(pool, k=rng.randrange(1, 20))) for _ in range(20)]
            (tmp_path / tier / f"{number}.txt").write_text("".join(t.hex() + "\n" for t in texts) + "zz\nabc\n")
            rows += [(tier, t) for t in texts]
        read = hex_lines(spark, str(tmp_path / tier), tier)
        lines = read if lines is None else lines.unionByName(read)
    payloads = counts.decoded(lines.withColumn("doc_id", F.struct(*LINE_ORDER)))
    trained = vocabulary.train_tiers(payloads, 5)
    expected = train_by_hand(rows, 5)
    for tier, table in trained.items():
        assert gram_dict(table) == expected[tier], tier
    assert expected["normal"]
