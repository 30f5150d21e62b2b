"""The data model: events, contracts, cursors, identities."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENT_SCHEMA = "sequence BIGINT NOT NULL, event_type STRING NOT NULL, payload STRING NOT NULL, timestamp BIGINT NOT NULL, origin_service STRING NOT NULL"
EVENT_COLUMNS = ["sequence", "event_type", "payload", "timestamp", "origin_service"]
CURSOR_SCHEMA = "source_service STRING, event_type STRING, last_sequence BIGINT, peer_address STRING, updated_at BIGINT"
CONTRACT_SCHEMA = "source_service STRING, event_types ARRAY<STRING>, peer_address STRING, retention_hint BIGINT"

#: Prefixes of event and cursor keys, and the event type of a cursor.
EVENT_PREFIX, CURSOR_PREFIX, CURSOR_EVENT_TYPE = "evt:", "_bc:", "_breadcrumb"
#: Greatest payload in bytes that a write accepts.
MAX_PAYLOAD = 4 * 1024 * 1024
EVENT_KEY = ["origin_service", "event_type", "sequence"]


class EventError(ValueError):
    """A rejected write or configuration."""


@dataclass(frozen=True)
class ServiceIdentity:
    name: str
    instance_id: str
    listen_address: str


@dataclass(frozen=True)
class Contract:
    """Which event types are consumed from a service, and where it is."""

    source_service: str
    event_types: tuple[str, ...]
    peer_address: str
    retention_hint: int | None = field(default=None)

    def row(self) -> tuple:
        return self.source_service, list(self.event_types), self.peer_address, self.retention_hint


def is_valid_event() -> Column:
    """Whether a row can be written: no nulls, no separators in names, sequence and payload in range."""
    names = [~F.col(c).rlike(r"[:|]") for c in ("origin_service", "event_type")]
    checks = [F.col(c).isNotNull() for c in EVENT_COLUMNS] + names
    checks += [F.col("sequence") >= 0, F.octet_length("payload") <= MAX_PAYLOAD]
    whole = checks[0]
    for check in checks[1:]:
        whole = whole & check
    return F.coalesce(whole, F.lit(False))
