"""Recovery: what a consumer is missing, pulled and taken in once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.contracts import FEW, any_of, explode_contracts
from eventloom.storage import join_small


def recovery_plan(pairs: DataFrame, cursors: DataFrame) -> DataFrame:
    """One task per contract and type: from behind the cursor, or from 0 without one.

    `pairs` has peer_address, source_service and event_type. Pairs that occur twice keep
    both tasks; cursors are unique per source and type.
    """
    at = cursors.select("source_service", "event_type", "last_sequence")
    return pairs.join(at, ["source_service", "event_type"], "left").select(
        "peer_address", "source_service", "event_type",
        F.coalesce(F.col("last_sequence") + 1, F.lit(0)).cast("long").alias("from_sequence"),
    )


def plan_for(contracts: DataFrame, cursors: DataFrame) -> DataFrame:
    return recovery_plan(explode_contracts(contracts), cursors)


def recovery_pull(plan: DataFrame, log: DataFrame, max_count: int = 0) -> DataFrame:
    """The events that the tasks of a plan ask of a log; `max_count` 0 means all of each task.

    A plan has a few tasks, so their streams and starts are a condition that reaches the scan.
    With more than `FEW` the tasks are joined, broadcast if their size allows.
    """
    tasks = plan.select(F.col("source_service").alias("origin_service"), "event_type", "from_sequence")
    wanted = tasks.groupBy("origin_service", "event_type").agg(F.min("from_sequence").alias("from_sequence"))
    rows = wanted.take(FEW + 1)
    if len(rows) <= FEW:
        found = log.where(any_of([
            (F.col("origin_service") == origin) & (F.col("event_type") == event_type) & (F.col("sequence") >= start) for origin, event_type, start in rows
        ]))
    else:
        found = join_small(log, wanted, ["origin_service", "event_type"]).where("sequence >= from_sequence").select(*log.columns)
    if not max_count:
        return found
    order = Window.partitionBy("origin_service", "event_type").orderBy("sequence")
    return found.withColumn("pull_rank", F.row_number().over(order)).where(F.col("pull_rank") <= max_count).drop("pull_rank")


def advanced_cursors(pulled: DataFrame, plan: DataFrame, now: int) -> DataFrame:
    """Cursors after a pull: the highest sequence of each stream that had rows in `pulled`.

    With what a peer sent these are the highest seen, with what the log kept the highest ingested.
    """
    seen = pulled.groupBy(F.col("origin_service").alias("source_service"), "event_type").agg(F.max("sequence").alias("last_sequence"))
    peers = plan.groupBy("source_service", "event_type").agg(F.min("peer_address").alias("peer_address"))
    return seen.join(peers, ["source_service", "event_type"]).select(
        "source_service", "event_type", "last_sequence", "peer_address", F.lit(now).cast("long").alias("updated_at")
    )
