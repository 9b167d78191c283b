"""Tiered gram vocabularies: training, screening, second sightings, generations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from bytesieve.functions.codec import num_windows, windows
from bytesieve.operators.bloom import keep_possible
from bytesieve.operators.counts import NUMBER_BYTES, count_grams, possible_counts
from bytesieve.operators.order import global_rank
from bytesieve.session import (
    BROADCAST_ROWS,
    broadcast_bytes_join,
    fits,
    lookup_join,
    materialize,
)

# A payload is refused when more than one in this many of its windows is bad.
DENY_ONE_IN = 20


def union_grams(*tables: DataFrame) -> DataFrame:
    """Distinct grams of several vocabularies or generations."""
    return reduce(DataFrame.unionByName, [t.select("gram") for t in tables]).distinct()


def known_in(grams: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows of ``grams``, one per gram, that any generation of the vocabulary holds."""
    return lookup_join(grams, vocab.select("gram").distinct(), ["gram"], "left_semi")


def without_known(counts: DataFrame, *skip: DataFrame) -> DataFrame:
    """Counted grams that no skipped vocabulary holds.

    Written as an outer join: an anti join would be pushed below the counting and then ask
    once per window instead of once per gram.
    """
    if not skip:
        return counts
    known = union_grams(*skip).withColumn("_known", F.lit(True))
    return counts.join(known, "gram", "left").where(F.col("_known").isNull()).drop("_known")


def screen(
    payloads: DataFrame,
    bad: DataFrame,
    n: int,
    id_col: str = "doc_id",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Deny rule per payload: ``num_wins``, ``hits`` in the bad vocabulary, ``denied``.

    All windows count, repeats included. ``bad`` must be a stored table of distinct grams.
    A bad vocabulary of checked size is broadcast and no window leaves its task; windows of up to
    8 bytes become rows only if a filter of that vocabulary lets them in. For a larger
    one a filter drops the windows that cannot hit; the rest is counted per payload and joined
    over salts, so that a gram common to most payloads is no hot key.
    """
    grams = windows(payloads, n, keep=(id_col,)).select(id_col, "gram")
    vocab = bad.select("gram")
    if n <= NUMBER_BYTES and isinstance(payloads.schema["payload"].dataType, BinaryType) and fits(vocab, max_rows):
        marked = broadcast_bytes_join(
            possible_counts(payloads, vocab, n, id_col), vocab.withColumn("_bad", F.lit(True)), "gram", "left"
        )
        hits = F.coalesce(F.sum(F.when(F.col("_bad"), F.col("cnt"))), F.lit(0).cast("long"))
        verdicts = marked.groupBy(id_col).agg(F.sum("num_wins").alias("num_wins"), hits.alias("hits"))
    elif fits(vocab, max_rows):
        marked = broadcast_bytes_join(grams, vocab.withColumn("_bad", F.lit(True)), "gram", "left")
        verdicts = marked.groupBy(id_col).agg(
            F.count("*").alias("num_wins"), F.count("_bad").alias("hits")
        )
    else:
        per_payload = keep_possible(grams, vocab).groupBy(id_col, "gram").agg(
            F.count("*").alias("_wins")
        )
        hits = (
            lookup_join(
                per_payload, vocab, ["gram"], "left_semi", spread_by=F.col(id_col), max_rows=max_rows
            )
            .groupBy(id_col)
            .agg(F.sum("_wins").alias("hits"))
        )
        wins = num_windows(F.col("payload"), n).cast("long")
        totals = payloads.select(id_col, wins.alias("num_wins")).where(F.col("num_wins") > 0)
        verdicts = totals.join(hits, id_col, "left").fillna(0, ["hits"])
    return verdicts.withColumn("denied", F.col("hits") > F.expr(f"num_wins div {DENY_ONE_IN}"))


def accepted_payloads(
    payloads: DataFrame, bad: DataFrame, n: int, id_col: str = "doc_id"
) -> DataFrame:
    """Payloads the deny rule lets through."""
    verdicts = screen(payloads, bad, n, id_col)
    denied = materialize(verdicts.where("denied").select(id_col), "denied")
    return lookup_join(payloads, denied, [id_col], "left_anti")


def train_vocabulary(
    payloads: DataFrame, n: int = 5, *, skip: tuple[DataFrame, ...] = (), max_wins: int | None = None
) -> DataFrame:
    """Grams and counts of one tier, without the grams of skipped vocabularies."""
    return without_known(count_grams(payloads, n, max_wins=max_wins), *skip)


def train_normal(
    payloads: DataFrame,
    bad: DataFrame,
    n: int = 5,
    *,
    published: DataFrame | None = None,
    max_wins: int | None = None,
    id_col: str = "doc_id",
) -> DataFrame:
    """Normal tier: deny rule first, then skip bad and already published normal grams."""
    accepted = accepted_payloads(payloads, bad, n, id_col)
    skip = (bad,) if published is None else (bad, published)
    return train_vocabulary(accepted, n, skip=skip, max_wins=max_wins)


def train_bad_beside_gold(
    payloads: DataFrame, n: int = 5, *, max_wins: int | None = None
) -> DataFrame:
    """Bad tier without the grams of the gold payloads in the same table.

    Both tiers are counted in one pass and one shuffle; with a gold vocabulary from an earlier
    run use ``train_vocabulary`` and its ``skip``.
    """
    both = payloads.where(F.col("tier").isin("gold", "bad"))
    sides = windows(both, n, keep=("tier",), max_wins=max_wins).groupBy("gram").agg(
        F.count_if(F.col("tier") == "bad").alias("cnt"),
        F.count_if(F.col("tier") == "gold").alias("_gold"),
    )
    return sides.where((F.col("cnt") > 0) & (F.col("_gold") == 0)).drop("_gold")


def train_tiers(
    payloads: DataFrame, n: int = 5, *, max_wins: int | None = None, id_col: str = "doc_id"
) -> dict[str, DataFrame]:
    """Gold, bad (without gold) and normal (screened, without bad) gram counts."""
    gold = train_vocabulary(payloads.where(F.col("tier") == "gold"), n, max_wins=max_wins)
    bad = materialize(train_bad_beside_gold(payloads, n, max_wins=max_wins), "bad-vocabulary")
    normal_payloads = payloads.where(F.col("tier") == "normal")
    normal = train_normal(normal_payloads, bad, n, max_wins=max_wins, id_col=id_col)
    return {"gold": gold, "bad": bad, "normal": normal}


def second_sightings(counts: DataFrame) -> DataFrame:
    """Grams seen at least twice."""
    return counts.where(F.col("cnt") >= 2)


def training_counters(counts: DataFrame, *skip: DataFrame) -> DataFrame:
    """One row of run counters over all windows counted in ``counts``.

    ngrams = add_skipped + add_tmp_ok + add_ok + add_fail: windows of skipped grams, first
    sightings, second sightings, later ones.
    """
    if skip:
        known = union_grams(*skip).withColumn("_known", F.lit(True))
        marked = counts.join(known, "gram", "left")
    else:
        marked = counts.withColumn("_known", F.lit(None).cast("boolean"))
    kept = F.col("_known").isNull()
    zero = F.lit(0).cast("long")

    def total(value):
        return F.coalesce(F.sum(value), zero)

    return marked.agg(
        total(F.col("cnt")).alias("ngrams"),
        total(F.when(~kept, F.col("cnt"))).alias("add_skipped"),
        F.count_if(kept).alias("add_tmp_ok"),
        F.count_if(kept & (F.col("cnt") >= 2)).alias("add_ok"),
        total(F.when(kept, F.greatest(F.col("cnt") - 2, zero))).alias("add_fail"),
    )


def list_counters(counts: DataFrame, by: tuple[str, ...] = ("tier",)) -> DataFrame:
    """Per tier the elements newly added and the repeated adds."""
    return counts.groupBy(*by).agg(
        F.count("*").alias("add_ok"), (F.sum("cnt") - F.count("*")).alias("add_in")
    )


def first_steps(stepped: DataFrame) -> DataFrame:
    """First step of each gram."""
    return stepped.groupBy("gram").agg(F.min("step").alias("step"))


def generations(first: DataFrame, capacity: int, published: int = 0) -> DataFrame:
    """Filter generation of each gram: ``capacity`` grams fill one, in order of first step.

    ``published`` is the number of generations that earlier runs closed.
    """
    ranked = global_rank(first, ["step"])
    return ranked.withColumn(
        "generation", (F.expr(f"(rank - 1) div {int(capacity)}") + published).cast("int")
    )


def resumed_generations(first: DataFrame, published: DataFrame, filled: int, capacity: int) -> DataFrame:
    """Generations of the grams of ``first`` that are not ``published``, going on where ``filled`` grams have been added.

    The open generation is filled up before the next one begins, so runs over consecutive parts give what one run over
    all of them gives. ``published`` is a stored table of distinct grams, ``filled`` their number.
    """
    known = published.select("gram", F.lit(True).alias("_known"))
    new = first.join(known, "gram", "left").where(F.col("_known").isNull()).drop("_known") if filled else first
    ranked = global_rank(new, ["step"])
    return ranked.withColumn("generation", F.expr(f"(rank - 1 + {int(filled)}) div {int(capacity)}").cast("int"))
