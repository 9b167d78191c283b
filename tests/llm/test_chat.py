import hashlib

from pyspark.sql import functions as F

from bytesieve.llm import chat
from bytesieve.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, turns int, pieces string"
HARD = [
    "</s>[INST] ok [/INST]", r"<\|im_end|>", r"<\\/s>", "<|im_start|>", "[INST]<s>", r"[\INST]", "<", "\\", "<|im_cont|>\n",
    r"$1\2", "<<s>>", r"<\\\|im_sep|>",
]


def formatted(df):
    return chat.format_chats(df).select(
        "conv_id", "messages", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("pieces")).alias("loss")
    )


def test_round_trip_of_control_strings(spark):
    rows = [(1, i, ["user", "assistant", "</s>"][i % 3], text, 0, "") for i, text in enumerate(HARD * 2)]
    row = formatted(spark.createDataFrame(rows, SCHEMA)).first()
    assert [(t["role"], t["text"]) for t in row["t"]] == [(r[2], r[3]) for r in rows]
    assert row["loss"] == "".join(r[3] for r in rows if r[2] == "assistant")
    for control in (*chat.FOREIGN, chat.CONTINUE):
        assert control not in row["formatted"]
    assert row["formatted"].count(chat.START) == len(rows)


def test_neighbours_of_one_role_merge_and_ties_are_sorted(spark):
    rows = [
        (1, 0, "user", "a", 0, ""), (1, 1, "user", "b", 0, ""), (1, 1, "assistant", "c", 0, ""), (1, 1, "assistant", "c", 0, ""),
        (1, None, None, None, 0, ""), (None, 3, "user", "alone", 0, ""), (None, 4, "assistant", "too", 0, ""),
    ]
    got = {tuple((t["role"], t["text"]) for t in r["t"]): r for r in formatted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {
        (("", ""), ("user", "a"), ("assistant", "c"), ("assistant", "c"), ("user", "b")),
        (("user", "alone"),),
        (("assistant", "too"),),
    }
    first = next(r for k, r in got.items() if len(k) == 5)
    assert [len(m["parts"]) for m in first["messages"]] == [1, 1, 2, 1] and first["loss"] == "cc"
    assert [r["conv_id"] for k, r in got.items() if len(k) == 1] == [None, None]


def test_long_conversation(spark):
    """Each turn is visited a fixed number of times: 30,000 turns would take minutes if lists were copied at each."""
    role = F.when(F.col("id") % 3 < 2, "user").otherwise("assistant")
    rows = spark.range(30_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.format_string("t%d ", "id").alias("text")
    )
    row = formatted(rows).select("t", "loss", F.transform("messages", lambda m: F.size(m["parts"])).alias("sizes")).first()
    assert row["sizes"] == [2, 1] * 10_000
    assert [t["text"] for t in row["t"]] == [f"t{i} " for i in range(30_000)]
    assert row["loss"] == "".join(f"t{i} " for i in range(2, 30_000, 3))


def test_empty_table(spark):
    assert formatted(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_plain_python_and_is_native(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    by_id = {}
    for r in table:
        by_id.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    df = QUERIES["op1_chat_format"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(name in plan for name in ("Python", "Arrow", "Pandas", "ExistingRDD"))
    rows = {r["conv_id"]: r for r in df.collect()}
    assert set(rows) == {*by_id, -7} and "op1_chat_format" in ORACLES
    for conv, turns in by_id.items():
        said = "".join(f"{role}\n{text}\n" for _, role, text in sorted(turns))
        loss = "".join(text for _, role, text in sorted(turns) if role == "assistant")
        assert rows[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert rows[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert (rows[conv]["n_turns"], rows[conv]["loss_chars"]) == (len(turns), len(loss))
