"""The training job: each run takes files that no run took before and adds them to the vocabulary of a tier.

Kept under one folder, and published together by one commit record (``sources.runs``):

* ``used``: names of the files taken,
* ``counts-<tier>``: gram counts, one part per run, added up when read,
* ``grams-<tier>``: each gram once, with the filter generation it was added to.

Gold grams are left out of the bad tier; payloads that the bad grams deny and bad grams are left out of the normal
one. So a tier's runs should follow those of the tiers it is screened by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesieve.operators import vocabulary
from bytesieve.operators.counts import decoded
from bytesieve.operators.order import counted_steps
from bytesieve.session import materialize
from bytesieve.sources.payloads import LINE_ORDER, file_names, hex_lines, unused_files
from bytesieve.sources.runs import State, commit, latest_state, load_parts, write_part

COUNTS = "gram binary, cnt long"
GRAMS = "gram binary, generation int"
# The tiers whose grams are left out of each tier.
SKIPPED = {"gold": (), "bad": ("gold",), "normal": ("bad",)}


def tier_counts(spark: SparkSession, root: str, state: State, tier: str) -> DataFrame:
    """Counts of all grams of a tier, added up over its runs."""
    parts = load_parts(spark, root, state, f"counts-{tier}", COUNTS)
    if len(state.tables.get(f"counts-{tier}", [])) < 2:
        return parts
    return parts.groupBy("gram").agg(F.sum("cnt").alias("cnt"))


def tier_grams(spark: SparkSession, root: str, state: State, tier: str) -> DataFrame:
    """Distinct grams of a tier with their filter generation."""
    return load_parts(spark, root, state, f"grams-{tier}", GRAMS)


def train_run(
    spark: SparkSession, root: str, tier: str, folder: str, *, files: int, n: int = 5, capacity: int, max_wins: int | None = None
) -> State | None:
    """Train ``tier`` on the first ``files`` unused files of ``folder``; None if there are none.

    Undecodable and short payloads are skipped. New grams go on filling the open generation of ``capacity`` grams in the
    order of their first window; grams of earlier runs keep theirs. Nothing is published before everything is written, and
    one run at a time may work on a ``root``.
    """
    state = latest_state(spark, root)
    used = load_parts(spark, root, state, "used", "tier string, name string").where(F.col("tier") == tier)
    taken = materialize(unused_files(file_names(spark, folder), used, files), "taken")
    names = [row["name"] for row in taken.collect()]
    if not names:
        return None
    lines = decoded(hex_lines(spark, names, tier)).where(F.col("payload").isNotNull())
    # Written once: positions of lines follow the splits, which a second reading could cut elsewhere.
    payloads = materialize(lines.select(F.struct(*LINE_ORDER).alias("line"), "payload"), "run-payloads")
    known = [tier_grams(spark, root, state, other).select("gram") for other in SKIPPED[tier]]
    if tier == "normal":
        payloads = materialize(vocabulary.accepted_payloads(payloads, known[0], n, "line"), "accepted")
    flat = payloads.select(*[F.col(f"line.{name}").alias(name) for name in LINE_ORDER], "payload")
    # Stored, one row per gram: a join with it must not be pushed below the counting, where each window would ask.
    stepped = materialize(counted_steps(flat, n, LINE_ORDER, max_wins=max_wins), "counted-steps")
    counted = vocabulary.without_known(stepped.select("gram", "cnt"), *known)
    added = {f"counts-{tier}": write_part(counted, root, f"counts-{tier}")}
    fresh = spark.read.schema(COUNTS).parquet(f"{root}/{added[f'counts-{tier}']}")

    first = vocabulary.first_steps(stepped)
    first = first.join(fresh.select("gram"), "gram", "left_semi") if known else first
    published = tier_grams(spark, root, state, tier).select("gram")
    filled = state.totals.get(f"grams-{tier}", 0)
    grams = vocabulary.resumed_generations(first, published, filled, capacity).select("gram", "generation")
    added[f"grams-{tier}"] = write_part(grams, root, f"grams-{tier}")
    new = spark.read.schema(GRAMS).parquet(f"{root}/{added[f'grams-{tier}']}").count()
    ngrams = fresh.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]

    added["used"] = write_part(taken.select(F.lit(tier).alias("tier"), "name"), root, "used")
    totals = {f"grams-{tier}": filled + new, f"windows-{tier}": state.totals.get(f"windows-{tier}", 0) + ngrams}
    return commit(spark, root, state, added, totals)


def compact(spark: SparkSession, root: str, tier: str) -> State:
    """Add the parts of a tier's counts up into one; a run of its own, which changes no result."""
    state = latest_state(spark, root)
    table = f"counts-{tier}"
    if len(state.tables.get(table, [])) < 2:
        return state
    part = write_part(tier_counts(spark, root, state, tier), root, table)
    return commit(spark, root, state, {table: part}, replaced=(table,))
