"""State of a job that runs again and again: parts of tables, named by one commit record per run.

A run writes its parts first, under names that no other run uses, and its commit record last. The record names
all parts of all tables, so the newest record is the whole state: a run that ends in between changes nothing, and what it
left is named by no record.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_RECORD = "run long, tables map<string, array<string>>, totals map<string, long>"


@dataclass(frozen=True)
class State:
    """Number of the newest run, the parts of every table and totals that runs add up."""

    run: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    totals: dict[str, int] = field(default_factory=dict)


def latest_state(spark: SparkSession, root: str) -> State:
    """State behind the newest run under ``root``; before the first run it is empty."""
    try:
        records = spark.read.schema(_RECORD).parquet(f"{root}/commits")
    except AnalysisException:
        return State()
    # One row per run; only the newest one leaves Spark.
    newest = records.where(F.col("run") == records.agg(F.max("run")).first()[0]).limit(2).collect()
    if not newest:
        return State()
    if len(newest) > 1:
        raise RuntimeError(f"two runs committed number {newest[0]['run']} under {root}; one at a time may run")
    return State(newest[0]["run"], dict(newest[0]["tables"]), dict(newest[0]["totals"]))


def write_part(df: DataFrame, root: str, table: str) -> str:
    """Write a part of ``table``; it counts once a commit record names it."""
    part = f"{table}/{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{part}")
    return part


def load_parts(spark: SparkSession, root: str, state: State, table: str, schema: str) -> DataFrame:
    """All rows of the parts of ``table`` that ``state`` names; none if it names no part."""
    parts = [f"{root}/{part}" for part in state.tables.get(table, [])]
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*parts)


def commit(
    spark: SparkSession,
    root: str,
    base: State,
    added: dict[str, str],
    totals: dict[str, int] | None = None,
    replaced: tuple[str, ...] = (),
) -> State:
    """Publish the run that follows ``base``: its ``added`` parts, one by table, become part of the state.

    Tables in ``replaced`` lose their older parts. The record is one file, and Spark shows it whole or not at all.
    """
    tables = {name: list(parts) for name, parts in base.tables.items()}
    for table, part in added.items():
        tables[table] = [part] if table in replaced else [*tables.get(table, []), part]
    state = State(base.run + 1, tables, base.totals | (totals or {}))
    record = spark.createDataFrame([(state.run, state.tables, state.totals)], _RECORD)
    record.coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return state
