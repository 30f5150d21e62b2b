"""Aggregates over logs and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.storage import checkpoint, join_small


def max_sequence(events: DataFrame) -> DataFrame:
    """Per origin the highest sequence number."""
    return events.groupBy("origin_service").agg(F.max("sequence").alias("max_sequence"))


def run_stats(keyed: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run the least and greatest key and sequence number, and the rows."""
    return keyed.groupBy(run).agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"),
        F.coalesce(F.min("sequence"), F.lit(0)).cast("long").alias("min_seq"),
        F.coalesce(F.max("sequence"), F.lit(0)).cast("long").alias("max_seq"),
        F.count(F.lit(1)).alias("num_entries"),
    )


def payload_bytes(events: DataFrame) -> DataFrame:
    """Per origin and type the events and the bytes of their payloads."""
    return events.groupBy("origin_service", "event_type").agg(
        F.count(F.lit(1)).alias("num_entries"), F.sum(F.octet_length("payload")).cast("long").alias("payload_bytes")
    )


def store_stats(keyed: DataFrame) -> DataFrame:
    """One row: rows, distinct keys and bytes of payloads."""
    return keyed.agg(
        F.count(F.lit(1)).alias("num_entries"), F.count_distinct("key").alias("num_keys"),
        F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).cast("long").alias("payload_bytes"),
    )


def running_payload(events: DataFrame, chunk: int = 4096) -> DataFrame:
    """Per event the bytes of its stream's payloads up to it, by sequence.

    Running sums within chunks of sequence numbers are added to the sums of the stream's
    chunks before, of which there is one row each, so that no task sorts a whole stream.
    """
    stream = ["origin_service", "event_type"]
    sized = events.select(*stream, "sequence", F.floor(F.col("sequence") / chunk).alias("chunk"), F.octet_length("payload").cast("long").alias("bytes"))
    before = Window.partitionBy(*stream).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpoint(
        sized.groupBy(*stream, "chunk").agg(F.sum("bytes").alias("chunk_bytes"))
        .select(*stream, "chunk", F.coalesce(F.sum("chunk_bytes").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy(*stream, "chunk").orderBy("sequence")
    return join_small(sized.withColumn("own", F.sum("bytes").over(within)), starts, [*stream, "chunk"]).select(
        *stream, "sequence", (F.col("start") + F.col("own")).cast("long").alias("bytes_so_far")
    )
