"""A continuous pull: new events of a folder are taken in batch by batch.

Each micro-batch is authorized, deduplicated against the log and committed together with
its cursors. A batch that runs again after a failure finds its keys stored, so delivery is
effectively once. Events at or below the cursor are late and never asked for again.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.model import EVENT_SCHEMA
from eventloom.operators.contracts import explode_contracts
from eventloom.plans import recovery
from eventloom.sources.event_log import EventLog


def beyond_cursor(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events above their stream's cursor."""
    at = cursors.select(F.col("source_service").alias("origin_service"), "event_type", "last_sequence")
    joined = events.join(at, ["origin_service", "event_type"], "left")
    return joined.where("last_sequence IS NULL OR sequence > last_sequence").select(*events.columns)


def ingest_batch(log: EventLog, batch: DataFrame) -> dict[str, int]:
    fresh = beyond_cursor(batch, log.cursors())
    return log.ingest(fresh, recovery.advanced_cursors(fresh, explode_contracts(log.contracts), int(time.time())))


def start_pull(log: EventLog, source: str, checkpoint: str, source_format: str = "parquet", **trigger) -> StreamingQuery:
    """Start a query that takes in the event files of `source`; `trigger` is as in `DataStreamWriter.trigger`."""
    stream = log.spark.readStream.schema(EVENT_SCHEMA).format(source_format).load(source)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: ingest_batch(log, batch) and None)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
