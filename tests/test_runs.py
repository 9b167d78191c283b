import random
from collections import Counter

import pytest
from helpers import gram_dict

from bytesieve.operators import order, training, vocabulary
from bytesieve.sources import runs

CAPACITY = 40


def write_files(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, payloads in files.items():
        (folder / name).write_text("".join(p.hex() + "\n" for p in payloads) + "zz\n")


@pytest.fixture
def folders(tmp_path):
    rng = random.Random(3)
    made = {}
    for tier in ("gold", "bad", "normal"):
        made[tier] = {f"{i}.txt": [bytes(rng.randrange(6) for _ in range(rng.randrange(60))) for _ in range(13)] for i in range(3)}
        write_files(tmp_path / tier, made[tier])
    return tmp_path, made


def train_all(spark, root, base, files):
    for tier in ("gold", "bad", "normal"):
        while training.train_run(spark, str(root), tier, str(base / tier), files=files, n=4, capacity=CAPACITY):
            pass
    state = runs.latest_state(spark, str(root))
    counts = {tier: gram_dict(training.tier_counts(spark, str(root), state, tier)) for tier in ("gold", "bad", "normal")}
    grams = {tier: gram_dict(training.tier_grams(spark, str(root), state, tier), "generation") for tier in counts}
    return state, counts, grams


def grams_of(payloads):
    return [p[i : i + 4] for p in payloads for i in range(len(p) - 3)]


def test_runs_equal_one_run_and_plain_counting(spark, folders, tmp_path):
    base, made = folders
    state, counts, grams = train_all(spark, tmp_path / "many", base, 2)
    once, counts_once, grams_once = train_all(spark, tmp_path / "once", base, 9)
    assert (state.run, once.run) == (6, 3) and state.totals == once.totals
    assert counts == counts_once and grams == grams_once
    payloads = {tier: [p for name in sorted(made[tier]) for p in made[tier][name]] for tier in made}
    gold = Counter(grams_of(payloads["gold"]))
    bad = Counter(g for g in grams_of(payloads["bad"]) if g not in gold)
    accepted = [p for p in payloads["normal"] if sum(g in bad for g in grams_of([p])) <= max(0, len(p) - 3) // 20]
    normal = Counter(g for g in grams_of(accepted) if g not in bad)
    assert counts == {"gold": gold, "bad": bad, "normal": normal} and normal and bad
    first = list(dict.fromkeys(grams_of(payloads["gold"])))
    assert grams["gold"] == {g: i // CAPACITY for i, g in enumerate(first)}
    assert state.totals["grams-gold"] == len(first) and state.totals["windows-gold"] == sum(gold.values())


def test_windows_are_gone_before_parts_are_joined(spark, folders, tmp_path, monkeypatch):
    """Joins with other tiers ask once per gram: what is written has no window in its plan."""
    base, _ = folders
    plans = []

    def write_planned(df, root, table):
        plans.append((table, df._jdf.queryExecution().optimizedPlan().toString()))
        return runs.write_part(df, root, table)

    monkeypatch.setattr(training, "write_part", write_planned)
    for tier in ("gold", "bad", "normal"):
        training.train_run(spark, str(tmp_path / "state"), tier, str(base / tier), files=9, n=4, capacity=CAPACITY)
    assert [table for table, _ in plans[3:]] == ["counts-bad", "grams-bad", "used", "counts-normal", "grams-normal", "used"]
    assert not [table for table, text in plans if "Generate" in text or "MapInArrow" in text]


def test_a_run_that_ends_early_changes_nothing(spark, folders, tmp_path, monkeypatch):
    base, _ = folders
    root = str(tmp_path / "state")
    options = {"files": 2, "n": 4, "capacity": CAPACITY}
    before = training.train_run(spark, root, "gold", str(base / "gold"), **options)
    kept = gram_dict(training.tier_counts(spark, root, before, "gold"))
    # Ends after each of the tables in turn.
    for failing in range(1, 4):
        written = []

        def write_some(df, root, table, failing=failing, written=written):
            if len(written) == failing:
                raise OSError("lost")
            written.append(table)
            return runs.write_part(df, root, table)

        with monkeypatch.context() as patch:
            patch.setattr(training, "write_part", write_some)
            if failing < 3:
                with pytest.raises(OSError):
                    training.train_run(spark, root, "gold", str(base / "gold"), **options)
            else:
                patch.setattr(training, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError):
                    training.train_run(spark, root, "gold", str(base / "gold"), **options)
        assert runs.latest_state(spark, root) == before
        assert gram_dict(training.tier_counts(spark, root, before, "gold")) == kept
    training.train_run(spark, root, "gold", str(base / "gold"), **options)
    state = runs.latest_state(spark, root)
    assert state.run == 2 and len(state.tables["used"]) == 2


def test_compaction_keeps_results(spark, folders, tmp_path):
    base, _ = folders
    root = str(tmp_path / "state")
    while training.train_run(spark, root, "gold", str(base / "gold"), files=2, n=4, capacity=CAPACITY):
        pass
    before = runs.latest_state(spark, root)
    counted = gram_dict(training.tier_counts(spark, root, before, "gold"))
    after = training.compact(spark, root, "gold")
    assert (len(before.tables["counts-gold"]), len(after.tables["counts-gold"])) == (2, 1)
    assert gram_dict(training.tier_counts(spark, root, runs.latest_state(spark, root), "gold")) == counted
    assert training.compact(spark, root, "gold") == after


def test_two_runs_at_once_are_noticed(spark, tmp_path):
    root = str(tmp_path / "state")
    assert runs.latest_state(spark, root) == runs.State()
    part = runs.write_part(spark.range(1), root, "used")
    for _ in range(2):
        runs.commit(spark, root, runs.State(), {"used": part})
    with pytest.raises(RuntimeError):
        runs.latest_state(spark, root)


def test_generations_go_on_where_they_were_left(spark, payload_table):
    rng = random.Random(9)
    payloads = [bytes(rng.randrange(5) for _ in range(rng.randrange(40))) for _ in range(60)]
    table = payload_table(payloads)
    first = list(dict.fromkeys(grams_of(payloads)))
    published = spark.createDataFrame([], "gram binary, generation int")
    for low, high in ((0, 7), (7, 8), (8, 60)):
        part = table.where(f"doc_id >= {low} AND doc_id < {high}")
        steps = vocabulary.first_steps(order.stepped_windows(part, 4, ["doc_id"]))
        new = vocabulary.resumed_generations(steps, published, published.count(), CAPACITY)
        published = published.unionByName(new.select("gram", "generation"))
    assert gram_dict(published, "generation") == {g: i // CAPACITY for i, g in enumerate(first)}
