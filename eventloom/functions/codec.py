"""Keys and text rows as column expressions. Lengths are bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.model import CURSOR_EVENT_TYPE, CURSOR_PREFIX, EVENT_PREFIX


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def event_prefix(origin="origin_service", event_type="event_type") -> Column:
    return F.concat(F.lit(EVENT_PREFIX), _col(origin), F.lit(":"), _col(event_type), F.lit(":"))


def event_key(origin="origin_service", event_type="event_type", sequence="sequence") -> Column:
    """Sixteen hex digits make the order of keys that of sequence numbers."""
    return F.concat(event_prefix(origin, event_type), F.lpad(F.lower(F.hex(_col(sequence))), 16, "0"))


def cursor_key(source="source_service", event_type="event_type") -> Column:
    return F.concat(F.lit(CURSOR_PREFIX), _col(source), F.lit(":"), _col(event_type))


def is_system_key(key="key") -> Column:
    return F.startswith(_col(key), F.lit(CURSOR_PREFIX))


def encode_event() -> Column:
    """sequence|timestamp|payload bytes|origin|type|payload"""
    return F.concat_ws("|", "sequence", "timestamp", F.octet_length("payload"), "origin_service", "event_type", "payload")


def _integer(text: Column, signed: bool = False) -> Column:
    """A number of digits only, or null; a sign may stand before it if `signed`."""
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z" if signed else r"\A\+?[0-9]+\z"), text.try_cast("bigint"))


def decode_events(rows: DataFrame, value: str = "value") -> DataFrame:
    """Add the fields of an encoded event and `valid`.

    A row is valid if it has all fields, whole numbers (only the timestamp may be negative), and a
    payload of the stated bytes.
    """
    part = lambda n: F.get(F.split(F.col(value), r"\|", 6), n)
    decoded = rows.select(
        "*",
        _integer(part(0)).alias("sequence"), _integer(part(1), signed=True).alias("timestamp"), _integer(part(2)).alias("payload_bytes"),
        part(3).alias("origin_service"), part(4).alias("event_type"), part(5).alias("payload"),
    )
    whole = F.col("sequence").isNotNull() & F.col("timestamp").isNotNull() & (F.octet_length("payload") == F.col("payload_bytes"))
    return decoded.withColumn("valid", F.coalesce(whole, F.lit(False)))


def valid_events(decoded: DataFrame) -> DataFrame:
    return decoded.where("valid").drop("valid", "payload_bytes")


def corrupt_rows(decoded: DataFrame, value: str = "value") -> DataFrame:
    return decoded.where("NOT valid").select(value)


def encode_cursor() -> Column:
    """last sequence|peer address"""
    return F.concat_ws("|", "last_sequence", "peer_address")


def decode_cursor(payload="payload") -> list[Column]:
    """last_sequence and peer_address of a cursor's payload."""
    parts = F.split(_col(payload), r"\|", 2)
    return [_integer(F.get(parts, 0)).alias("last_sequence"), F.get(parts, 1).alias("peer_address")]


def cursors_as_events(cursors: DataFrame, own: str) -> DataFrame:
    """Cursors as keyed events of the service `own`."""
    return cursors.select(
        cursor_key().alias("key"), F.col("last_sequence").alias("sequence"), F.lit(CURSOR_EVENT_TYPE).alias("event_type"),
        encode_cursor().alias("payload"), F.col("updated_at").alias("timestamp"), F.lit(own).alias("origin_service"),
    )


def events_as_cursors(keyed: DataFrame) -> DataFrame:
    """The cursors among keyed events; the source ends at the first colon behind the prefix."""
    rest = F.split(F.substring("key", len(CURSOR_PREFIX) + 1, 1 << 30), ":", 2)
    return keyed.where(is_system_key() & (F.size(rest) == 2)).select(
        F.get(rest, 0).alias("source_service"), F.get(rest, 1).alias("event_type"), *decode_cursor(), F.col("timestamp").alias("updated_at")
    )
