"""Newest-wins and first-wins per key, and merges of sorted runs.

The order is always explicit: dropping duplicates without one keeps an arbitrary row.
Row numbers with a bound let Spark limit each group before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("key_rank", rank).where("key_rank = 1").drop("key_rank")


def newest_per_key(df: DataFrame, key: str | list[str] = "key", order: str = "write_order") -> DataFrame:
    return _first(df, [key] if isinstance(key, str) else key, [F.desc(order)])


def first_per_key(df: DataFrame, key: str | list[str] = "key", order: str = "write_order") -> DataFrame:
    return _first(df, [key] if isinstance(key, str) else key, [F.asc(order)])


def merge_runs(rows: DataFrame, key: str = "key") -> DataFrame:
    """One row per key out of runs (level, run_id): the lower level wins, then the newer run."""
    return _first(rows, [key], [F.asc("level"), F.desc("run_id"), F.desc("sequence")])


def union_runs(runs: list[DataFrame]) -> DataFrame:
    """Runs from oldest to newest as one table with level 0 and run_id."""
    numbered = [r.withColumn("level", F.lit(0)).withColumn("run_id", F.lit(n)) for n, r in enumerate(runs)]
    return reduce(DataFrame.unionByName, numbered)


def not_stored(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return incoming.join(stored.select(*keys), keys, "left_anti")
