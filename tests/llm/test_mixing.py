from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from bytesieve.llm import mixing
from bytesieve.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.01"


def plain_shares(children, budget):
    """Sharing by weight in rounds: full children leave, what they cannot take goes to the others."""
    open_, quota = dict(children), {}
    while open_:
        weights = sum(w for w, _ in open_.values())
        full = {c: cap for c, (w, cap) in open_.items() if cap <= Fraction(budget * w, weights)}
        if not full:
            return quota | {c: budget * w // weights for c, (w, _) in open_.items()}
        quota |= full
        budget -= sum(full.values())
        open_ = {c: v for c, v in open_.items() if c not in full}
    return quota


def test_shortages_go_to_siblings(spark):
    cases = [
        ({"a": (1, 10), "b": (1, 100), "c": (2, 100)}, 130), ({"a": (5, 7)}, 7), ({"a": (1, 50), "b": (3, 50)}, 100),
        ({c: (i % 3 + 1, i * 7 % 40 + 1) for i, c in enumerate("abcdefghij")}, 111), ({"a": (1, 5), "b": (1, 5)}, 0),
    ]
    rows = [(i, c, w, cap, b) for i, (children, b) in enumerate(cases) for c, (w, cap) in children.items()]
    table = spark.createDataFrame(rows, "p int, c string, weight long, capacity long, b long")
    got = {}
    for r in mixing.share_out(table, ["p"], "c", F.col("b")).collect():
        got.setdefault(r["p"], {})[r["c"]] = r["quota"]
    assert [got[i] for i in range(len(cases))] == [plain_shares(*case) for case in cases]


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    result = duck.execute(ORACLES["op10_mix"])
    names = [d[0] for d in result.description]
    df = QUERIES["op10_mix"](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(result.fetchall())
    quotas = {(r["domain"], r["lang"], r["source"]): r["quota"] for r in df.collect()}
    used = {}
    for r in df.collect():
        key = (r["domain"], r["lang"], r["source"])
        used[key] = used.get(key, 0) + r["tokens"]
    assert all(used[k] <= quotas[k] for k in used)
    assert sum(used.values()) > 0.8 * sum(quotas.values())


def test_odd_rows(odd, nothing):
    domain = F.col("source")
    rows = mixing.mix(odd, domain=domain, weights={}, budget_share=2.0, max_epochs=2).collect()
    words = [(r["doc"]["doc_id"], r["mix"]["epoch"]) for r in rows if r["mix"]["tokens"]]
    # The budget allows everything twice: each row with tokens is there twice.
    assert sorted(words, key=repr) == sorted(((d, e) for d in (1, 1, 5, 7, 8, 9, None) for e in (0, 1)), key=repr)
    assert rows[0]["doc"].asDict().keys() == set(odd.columns)
    assert mixing.mix(nothing, domain=domain, weights={}).collect() == []
    none = mixing.mix(odd, domain=domain, weights={}, budget_share=0.0)
    assert none.collect() == []
