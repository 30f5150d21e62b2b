"""Lookups, scans and ordered suffixes. Filters reach the Parquet scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.model import EVENT_PREFIX
from eventloom.storage import join_small

_EVENT_KEY = r"(?s)\Aevt:([^:]*):([^:]*):([0-9a-f]{16})\z"


def key_parts(key="key") -> list[Column]:
    """Origin, type and sequence number that an event key names; nulls if it is no event key."""
    column = F.col(key) if isinstance(key, str) else key
    part = lambda n: F.when(column.rlike(_EVENT_KEY), F.regexp_extract(column, _EVENT_KEY, n))
    return [part(1).alias("origin_service"), part(2).alias("event_type"), F.conv(part(3), 16, 10).try_cast("bigint").alias("sequence")]


def parse_event_key(key: str) -> tuple[str, str, int] | None:
    """(origin, type, sequence) of an event key."""
    found = re.fullmatch(r"evt:([^:]*):([^:]*):([0-9a-f]{16})", key)
    return (found[1], found[2], int(found[3], 16)) if found else None


def point_get(keyed: DataFrame, key: str) -> DataFrame:
    """The rows of a key. An event key is looked up by its parts, which reach the scan; other keys by the key."""
    parts = parse_event_key(key)
    if not parts:
        return keyed.where(F.col("key") == key)
    origin, event_type, sequence = parts
    return keyed.where(
        (F.col("origin_service") == origin) & (F.col("event_type") == event_type) & (F.col("sequence") == sequence) & (F.col("key") == key)
    )


def contains(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `keys` with `found`: whether the key is stored.

    Rows of the log that no key asks for leave at the scan: a few keys are broadcast, and the
    range of their sequence numbers is a filter.
    """
    asked = keys.select("key", *key_parts()).distinct()
    ends = asked.agg(F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.count_if(F.col("sequence").isNull()).alias("free")).first()
    rows = keyed if ends["free"] else keyed.where(F.col("sequence").between(ends["low"], ends["high"]))
    stored = join_small(rows.select("key"), asked.select("key"), "key", "left_semi").distinct().withColumn("found", F.lit(True))
    return keys.join(stored, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def scan_prefix(keyed: DataFrame, prefix: str) -> DataFrame:
    """All rows whose key starts with `prefix`."""
    return keyed.where(F.col("key").startswith(prefix))


def parse_event_prefix(prefix: str) -> tuple[str, str] | None:
    """(origin, type) if the prefix names one stream, so that partitions can be pruned."""
    parts = prefix.removeprefix(EVENT_PREFIX).split(":")
    return (parts[0], parts[1]) if prefix.startswith(EVENT_PREFIX) and len(parts) == 3 and not parts[2] else None


def query_events(events: DataFrame, origin: str, event_type: str, from_sequence: int = 0, max_count: int = 0) -> DataFrame:
    """One stream from a sequence number on, in order. `max_count` 0 means all."""
    found = events.where(
        (F.col("origin_service") == origin) & (F.col("event_type") == event_type) & (F.col("sequence") >= from_sequence)
    ).orderBy("sequence")
    return found.limit(max_count) if max_count > 0 else found


def seek_sequence(events: DataFrame, sequence: int) -> DataFrame:
    return events.where(F.col("sequence") == sequence)
