"""Every registered query on the smallest tables, against its SQL where there is one."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from bytesieve.plans.registry import QUERIES as REGISTERED

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert as_rows(df.columns, df.collect()) == as_rows(columns, result.fetchall())


@pytest.fixture(scope="module")
def without_sql(spark):
    return {name: QUERIES[name](spark, SF_DIR).collect() for name in REGISTERED if name not in ORACLES}


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_sketches_and_filters_stay_in_bounds(without_sql, spark):
    exact = QUERIES["exact_counts"](spark, SF_DIR).count()
    assert without_sql["distinct_estimate"][0]["distinct_grams"] == pytest.approx(exact, rel=0.03)
    for row in without_sql["bloom_fill"]:
        assert row["bits_set"] == pytest.approx(row["expected_bits"], rel=0.01)
    probed = {(r["member"], r["maybe"]): r["grams"] for r in without_sql["bloom_probe"]}
    assert (True, False) not in probed
    union = QUERIES["bloom_union"](spark, SF_DIR).first()
    assert union["buckets"] == union["equal_buckets"]
    slots = without_sql["hash_slots"]
    assert sum(r["grams"] for r in slots) == 8 * exact
    assert max(r["grams"] for r in slots) < 1.3 * exact / 100
    signed = without_sql["signed_frequency_sketch"]
    assert len(signed) == exact
    frequent = [r for r in signed if r["cnt"] >= 500]
    assert all(abs(r["estimate"] - r["cnt"]) < 0.2 * r["cnt"] for r in frequent)


def test_heavy_hitters_are_exact_when_nothing_is_evicted(without_sql, spark):
    from bytesieve.operators.counts import count_grams
    from bytesieve.plans.inputs import payloads

    exact = {
        (r["tier"], bytes(r["gram"]).hex()): r["cnt"]
        for r in count_grams(payloads(spark, SF_DIR), 5, by=("tier",)).collect()
    }
    rows = without_sql["heavy_hitter_sketch"]
    assert len(rows) == 300
    assert all(exact[r["tier"], r["gram_hex"]] == r["cnt"] for r in rows)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["gram_hex", "cnt"] and df.count() > 40_000
