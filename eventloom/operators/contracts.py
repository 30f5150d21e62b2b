"""Which events a service may take in.

Contracts are configuration. Up to `FEW` streams of them become a condition on origin and type,
which reaches the scan and needs no join; more are joined, broadcast if their size allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.storage import join_small

#: Streams that a condition lists.
FEW = 200


def explode_contracts(contracts: DataFrame) -> DataFrame:
    """One row per contract and event type, in the order of the contracts."""
    placed = contracts.select("*", F.posexplode("event_types").alias("type_order", "event_type"))
    return placed.drop("event_types", "type_order")


def streams_of(pairs: DataFrame) -> DataFrame:
    """Distinct origin_service and event_type of pairs without nulls."""
    return pairs.select(F.col("source_service").alias("origin_service"), "event_type").dropna().distinct()


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def in_streams(streams: DataFrame) -> Column | None:
    """A condition for the streams, or None if they are too many to list."""
    rows = streams.take(FEW + 1)
    if len(rows) > FEW:
        return None
    types: dict[str, list[str]] = {}
    for origin, event_type in rows:
        types.setdefault(origin, []).append(event_type)
    return any_of([(F.col("origin_service") == origin) & F.col("event_type").isin(sorted(own)) for origin, own in sorted(types.items())])


def authorize(events: DataFrame, pairs: DataFrame, identity: str | None) -> DataFrame:
    """Events of the own origin or under a contract (source_service, event_type); all, without an identity."""
    if identity is None:
        return events
    streams = streams_of(pairs)
    own, agreed = F.col("origin_service") == identity, in_streams(streams)
    if agreed is not None:
        return events.where(own | agreed)
    keys = ["origin_service", "event_type"]
    return join_small(events, streams.withColumn("agreed", F.lit(True)), keys, "left").where(own | F.col("agreed")).select(*events.columns)


def reject(events: DataFrame, pairs: DataFrame, identity: str | None) -> DataFrame:
    """The events that `authorize` leaves out."""
    if identity is None:
        return events.where(F.lit(False))
    streams = streams_of(pairs)
    others, agreed = events.where(F.col("origin_service") != identity), in_streams(streams)
    if agreed is not None:
        return others.where(~agreed)
    return join_small(others, streams, ["origin_service", "event_type"], "left_anti").select(*events.columns)


def cursors_under_contract(cursors: DataFrame, pairs: DataFrame) -> DataFrame:
    return cursors.join(pairs.select("source_service", "event_type").distinct(), ["source_service", "event_type"], "left_semi")
