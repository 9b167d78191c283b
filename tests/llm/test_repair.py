import hashlib
import random
import time
import zlib

from pyspark.sql import functions as F

from bytesieve.llm import queries, repair
from bytesieve.llm.repair import AFTER, CLOSED, OPEN, START, SYSTEM, WANTED, Search


def cheapest(rows):
    """(cost, edits) by dynamic programming from the end over whole strings of edits."""
    best = {START: (0, ""), CLOSED: (0, ""), OPEN: (2, "I"), SYSTEM: (4, "II")}
    for initial, fault in reversed(rows):
        after, best = best, {}

        def take(state, initial=initial, fault=fault, after=after):
            found = [(after[state][0] + 3, "D" + after[state][1])]
            if fault not in ("b", "d"):
                cut = int(fault == "t")
                edits = [("K", cut, AFTER.get((state, initial))), ("R", 2 + cut, AFTER[state, WANTED[state]])]
                found += [(after[to][0] + cost, letter + after[to][1]) for letter, cost, to in edits if to is not None]
            return min(found)

        for state in WANTED:
            reached, found = state, [take(state)]
            for inserts in range(1, 5):
                reached = AFTER[reached, WANTED[reached]]
                cost, edits = take(reached)
                found.append((cost + 2 * inserts, "I" * inserts + edits))
            best[state] = min(found)
    return best[START]


def random_rows(rng, n):
    return [(rng.choice("suaxuaua"), rng.choice(["", "", "", "b", "d", "t", "t"])) for _ in range(n)]


def test_search_equals_dynamic_programming():
    rng = random.Random(3)
    for n in [0, 1, 2, 3, 4, 5, 7, 9] * 100 + [31, 32, 33, 64, 65, 97, 130] * 5:
        rows = random_rows(rng, n)
        assert Search(rows).best() == cheapest(rows)


def test_long_conversations_take_time_in_proportion():
    rng = random.Random(4)
    for rows in (random_rows(rng, 6000), [("u", "")] * 6000):
        began = time.perf_counter()
        assert Search(rows).best() == cheapest(rows)
        assert time.perf_counter() - began < 15


def expected(rows):
    """Result of one conversation by plain Python, from its undamaged rows (conv_id, turn, role, text)."""
    turns = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if value is None else value for value in (role, text))
        kind = zlib.crc32(name.encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        turns += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    faults, seen = [], set()
    for _, role, text in turns:
        words = text.strip(" \t\n\v\f\r")
        faults.append("b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in turns]
    cost, audit = cheapest(list(zip(initials, faults, strict=True)))
    left, i, state = [], 0, START
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        initial = turns[i][1][:1] if letter == "K" else WANTED[state]
        role = turns[i][1] if letter == "K" else {"u": "user", "a": "assistant"}[initial]
        left.append(f"{role}:{turns[i][2] if letter != 'I' else ''}")
        state, i = AFTER[state, initial], i + (letter != "I")
    numbers = {turn for turn, _, _ in turns if turn is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    digest = hashlib.sha256("\n".join(left).encode()).hexdigest()
    return (rows[0][0], gaps, *map(faults.count, "bdt"), illegal, cost, audit, digest)


def test_query_equals_brute_force(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rng = random.Random(8)
    for conv in range(1000, 1150):
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "what", " ", None, "same", "Ends. \n", f"t{turn}?", "é…"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 20, None]), role, text))
    rows += [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (2000, None, None, None), (2001, 3, "user", "Hi.")]
    dropped = next(c for c in range(3000, 4000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    got = sorted(map(tuple, queries.op13_structure_repair(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(map(expected, groups.values()), key=repr)
    empty = next(r for r in got if r[0] == dropped)
    assert empty[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns_and_odd_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", "Hello"), (1, 5, "user", "Bye.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("audit", F.lit("x"))
    row = repair.repair(repair.gathered(frame)).first()
    assert (row["gaps"], row["duplicate"], row["truncated"], row["illegal"]) == (1, 1, 1, 1)
    assert (row["cost"], row["audit"]) == (6, "KKDKKI")
    assert [tuple(t) for t in row["repaired"]][-2:] == [("user", "Bye."), ("assistant", "")]
    for empty in (frame.where("false"), frame.where("false").withColumn("turn", F.lit(None).cast("long"))):
        assert repair.repair(repair.gathered(empty)).collect() == []
    bare = frame.select("conv_id").distinct().withColumn("turns", F.lit(None).cast("array<struct<turn: long, role: string, text: string>>"))
    assert tuple(repair.repair(bare).first())[1:] == (0, 0, 0, 0, 0, 0, "", [])


def test_a_very_long_text_and_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Text {i}.") for i in range(3000)] + [(2, 0, "user", "word " * 400_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in repair.repair(repair.gathered(frame)).collect()}
    assert (got[1]["cost"], got[1]["audit"]) == (0, "K" * 3000)
    assert (got[2]["cost"], got[2]["audit"], got[2]["truncated"]) == (3, "D", 1)
