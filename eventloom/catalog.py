"""The event-log queries over the driver's `events` table, and their SQL twins.

`events` becomes a log: svc-0 to svc-4 by user, sequence numbers from 1 on, properties
as payload. Contracts and cursors are small inline tables. The `log_` queries and `kv_put_get`
write all rows to a durable log in the shared folder and read them from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import codec
from eventloom.operators import contracts, merge, scan, sequences, stats
from eventloom.plans import recovery
from eventloom.sources.event_log import EventLog
from eventloom.storage import new_path

IDENTITY = "svc-0"
CONTRACTS = [("svc-1", "click"), ("svc-1", "view"), ("svc-2", "error"), ("svc-9", "click")]
CURSORS = [("svc-1", "click", 5000), ("svc-2", "error", 9000), ("svc-3", "view", 10)]
A_KEY = "evt:svc-1:click:00000000000013a5"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as keyed events, with a free-form key that collides (`bk`)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(
        (F.col("event_id") + 1).alias("sequence"), "event_type", F.col("props").alias("payload"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("origin_service"), "user_id",
    )
    free = F.concat("origin_service", F.lit(":u"), F.col("user_id").cast("string"), F.lit(":"), "event_type")
    return rows.select(codec.event_key().alias("key"), *[c for c in rows.columns if c != "user_id"], free.alias("bk"))


def _pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*c, "peer:1") for c in CONTRACTS], "source_service string, event_type string, peer_address string")


def _cursors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*c, "peer:1", 7) for c in CURSORS], "source_service string, event_type string, last_sequence long, peer_address string, updated_at long")


def _runs(spark, d):
    return log(spark, d).withColumn("run_id", F.floor((F.col("sequence") - 1) / 1000))


def _leveled(spark, d):
    run = F.col("sequence") % 7
    return log(spark, d).withColumn("run_id", run).withColumn("level", F.when(run < 3, 1).otherwise(0))


def _plan(spark):
    return recovery.recovery_plan(_pairs(spark), _cursors(spark))


def _coded(spark, d):
    mixed = log(spark, d).select("key", F.when(F.col("sequence") % 100 == 0, F.lit("1|100|1|svc|a|b|x"))
                                 .when(F.col("sequence") % 100 == 1, F.lit("bad")).otherwise(codec.encode_event()).alias("value"))
    return codec.decode_events(mixed)


def _durable(spark, d):
    """The log with an event type that is empty for every seventh event, written once and sent again."""
    events = log(spark, d).withColumn("event_type", F.when(F.col("sequence") % 7 == 0, "").otherwise(F.col("event_type")))
    store = EventLog(spark, new_path(spark, "log"))
    store.append(events)
    store.ingest(events.withColumn("payload", F.lit("again")))
    return store.events().select("key", "sequence", "event_type", "payload", "timestamp", "origin_service")


def _batches(spark, d):
    """Five writes to a log: the first four become one batch of the next level."""
    store = EventLog(spark, new_path(spark, "log"))
    for n in range(5):
        store.append(log(spark, d).where(F.col("sequence") % 5 == n))
    return store.batches().groupBy("level").agg(F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("num_entries"))


def _values(spark, d):
    """Values of free-form keys, written in two batches."""
    rows = log(spark, d).select(F.col("bk").alias("key"), F.lpad(F.col("sequence").cast("string"), 12, "0").alias("value"), "sequence")
    store = EventLog(spark, new_path(spark, "log"))
    for rest in (1, 0):
        store.put_values(rows.where(F.col("sequence") % 2 == rest))
    return store.scan_values("svc-1:")


QUERIES = {
    "query_events": lambda s, d: scan.query_events(log(s, d), "svc-1", "click", 700).select("key", "sequence", "timestamp", "payload"),
    "scan_prefix": lambda s, d: scan.scan_prefix(log(s, d), "evt:svc-1:click:").select("key", "sequence"),
    "point_get": lambda s, d: scan.point_get(log(s, d), A_KEY).select("key", "sequence", "payload"),
    "contains": lambda s, d: scan.contains(log(s, d), s.createDataFrame([(A_KEY,), ("nothing",)], "key string")),
    "seek_sequence": lambda s, d: scan.seek_sequence(log(s, d), 777).select("key", "sequence"),
    "max_count_pull": lambda s, d: scan.query_events(log(s, d), "svc-1", "click", 700, 10).select("key", "sequence"),
    "put_lww": lambda s, d: merge.newest_per_key(log(s, d), "bk", "sequence").select("bk", "sequence"),
    "ingest_fww": lambda s, d: merge.first_per_key(log(s, d), "bk", "sequence").select("bk", "sequence"),
    "lsm_merge": lambda s, d: merge.merge_runs(_leveled(s, d), "bk").select("bk", "sequence", "level", "run_id"),
    "not_stored": lambda s, d: merge.not_stored(log(s, d), log(s, d).where("sequence % 3 = 0"), ["key"]).select("key", "sequence"),
    "contract_semi": lambda s, d: contracts.authorize(log(s, d), _pairs(s), IDENTITY).select("key", "sequence"),
    "contract_anti": lambda s, d: contracts.reject(log(s, d), _pairs(s), IDENTITY).select("key", "sequence"),
    "cursor_contracts": lambda s, d: contracts.cursors_under_contract(_cursors(s), _pairs(s)).select("source_service", "event_type", "last_sequence"),
    "max_seq": lambda s, d: stats.max_sequence(log(s, d)),
    "assign_seq": lambda s, d: sequences.assign_sequences(
        log(s, d).select("key", "origin_service", F.col("sequence").alias("arrival")), s.createDataFrame([("svc-1", 100)], "origin_service string, max_sequence long")
    ).select("key", "sequence"),
    "recovery_plan": lambda s, d: _plan(s).select("source_service", "event_type", "from_sequence"),
    "recovery_pull": lambda s, d: recovery.recovery_pull(_plan(s), log(s, d)).select("key", "sequence"),
    "recovery_pull_limited": lambda s, d: recovery.recovery_pull(_plan(s), log(s, d), 5).select("key", "sequence"),
    "cursor_advance": lambda s, d: recovery.advanced_cursors(recovery.recovery_pull(_plan(s), log(s, d)), _plan(s), 9).select("source_service", "event_type", "last_sequence"),
    "sst_stats": lambda s, d: stats.run_stats(_runs(s, d)),
    "payload_bytes": lambda s, d: stats.payload_bytes(log(s, d)),
    "store_stats": lambda s, d: stats.store_stats(log(s, d)),
    "running_payload": lambda s, d: stats.running_payload(log(s, d)),
    "system_keys": lambda s, d: log(s, d).select("key").union(_cursors(s).select(codec.cursor_key())).where(codec.is_system_key()),
    "cursor_codec": lambda s, d: codec.events_as_cursors(codec.cursors_as_events(_cursors(s), IDENTITY)),
    "codec_round_trip": lambda s, d: codec.valid_events(_coded(s, d)).select("sequence", "timestamp", "origin_service", "event_type", "payload"),
    "corrupt_rows": lambda s, d: codec.corrupt_rows(_coded(s, d)).groupBy("value").agg(F.count(F.lit(1)).alias("n")),
    "log_round_trip": _durable,
    "log_batches": _batches,
    "kv_put_get": _values,
}

_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
_LOG = f"""
WITH base AS (
  SELECT event_id + 1 AS sequence, event_type, props AS payload, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp,
         'svc-' || CAST(user_id % 5 AS VARCHAR) AS origin_service, user_id FROM events),
log AS (
  SELECT 'evt:' || origin_service || ':' || event_type || ':' || printf('%016x', sequence) AS key, sequence, event_type, payload,
         timestamp, origin_service, origin_service || ':u' || CAST(user_id AS VARCHAR) || ':' || event_type AS bk,
         CAST(sequence AS VARCHAR) || '|' || CAST(timestamp AS VARCHAR) || '|' || CAST(strlen(payload) AS VARCHAR) || '|'
           || origin_service || '|' || event_type || '|' || payload AS coded
  FROM base),
contracts(source_service, event_type) AS (VALUES {_VALUES(CONTRACTS)}),
crumbs(source_service, event_type, last_sequence) AS (VALUES {_VALUES(CURSORS)}),
plan AS (
  SELECT source_service, event_type, CAST(coalesce(last_sequence + 1, 0) AS BIGINT) AS from_sequence
  FROM contracts LEFT JOIN crumbs USING (source_service, event_type)),
pulled AS (
  SELECT l.* FROM log l JOIN plan p ON l.origin_service = p.source_service AND l.event_type = p.event_type AND l.sequence >= p.from_sequence)
"""
_STREAM = "origin_service = 'svc-1' AND event_type = 'click' AND sequence >= 700"
_IN_CONTRACT = "EXISTS (SELECT 1 FROM contracts c WHERE c.source_service = origin_service AND c.event_type = log.event_type)"
_NEWEST = "SELECT bk, sequence FROM log QUALIFY row_number() OVER (PARTITION BY bk ORDER BY sequence {}) = 1"

ORACLE_SQL = {
    name: _LOG + sql
    for name, sql in {
        "query_events": f"SELECT key, sequence, timestamp, payload FROM log WHERE {_STREAM}",
        "scan_prefix": "SELECT key, sequence FROM log WHERE starts_with(key, 'evt:svc-1:click:')",
        "point_get": f"SELECT key, sequence, payload FROM log WHERE key = '{A_KEY}'",
        "contains": f"SELECT k AS key, k IN (SELECT key FROM log) AS found FROM (VALUES ('{A_KEY}'), ('nothing')) t(k)",
        "seek_sequence": "SELECT key, sequence FROM log WHERE sequence = 777",
        "max_count_pull": f"SELECT key, sequence FROM log WHERE {_STREAM} ORDER BY sequence LIMIT 10",
        "put_lww": _NEWEST.format("DESC"),
        "ingest_fww": _NEWEST.format("ASC"),
        "lsm_merge": """SELECT bk, sequence, level, run_id FROM (
            SELECT *, sequence % 7 AS run_id, CAST(CASE WHEN sequence % 7 < 3 THEN 1 ELSE 0 END AS INTEGER) AS level FROM log)
            QUALIFY row_number() OVER (PARTITION BY bk ORDER BY level, run_id DESC, sequence DESC) = 1""",
        "not_stored": "SELECT key, sequence FROM log WHERE sequence % 3 <> 0",
        "contract_semi": f"SELECT key, sequence FROM log WHERE origin_service = '{IDENTITY}' OR {_IN_CONTRACT}",
        "contract_anti": f"SELECT key, sequence FROM log WHERE origin_service <> '{IDENTITY}' AND NOT {_IN_CONTRACT}",
        "cursor_contracts": "SELECT source_service, event_type, CAST(last_sequence AS BIGINT) AS last_sequence FROM crumbs SEMI JOIN contracts USING (source_service, event_type)",
        "max_seq": "SELECT origin_service, max(sequence) AS max_sequence FROM log GROUP BY 1",
        "assign_seq": """SELECT key, CAST(row_number() OVER (PARTITION BY origin_service ORDER BY sequence)
            + CASE WHEN origin_service = 'svc-1' THEN 100 ELSE 0 END AS BIGINT) AS sequence FROM log""",
        "recovery_plan": "SELECT * FROM plan",
        "recovery_pull": "SELECT key, sequence FROM pulled",
        "recovery_pull_limited": "SELECT key, sequence FROM pulled QUALIFY row_number() OVER (PARTITION BY origin_service, event_type ORDER BY sequence) <= 5",
        "cursor_advance": "SELECT origin_service AS source_service, event_type, max(sequence) AS last_sequence FROM pulled GROUP BY 1, 2",
        "sst_stats": """SELECT (sequence - 1) // 1000 AS run_id, min(key) AS min_key, max(key) AS max_key, min(sequence) AS min_seq,
            max(sequence) AS max_seq, count(*) AS num_entries FROM log GROUP BY 1""",
        "payload_bytes": """SELECT origin_service, event_type, count(*) AS num_entries, CAST(sum(strlen(payload)) AS BIGINT) AS payload_bytes
            FROM log GROUP BY 1, 2""",
        "store_stats": "SELECT count(*) AS num_entries, count(DISTINCT key) AS num_keys, CAST(sum(strlen(payload)) AS BIGINT) AS payload_bytes FROM log",
        "running_payload": """SELECT origin_service, event_type, sequence,
            CAST(sum(strlen(payload)) OVER (PARTITION BY origin_service, event_type ORDER BY sequence) AS BIGINT) AS bytes_so_far FROM log""",
        "system_keys": "SELECT key FROM (SELECT key FROM log UNION ALL SELECT '_bc:' || source_service || ':' || event_type FROM crumbs) WHERE starts_with(key, '_bc:')",
        "cursor_codec": """SELECT source_service, event_type, CAST(last_sequence AS BIGINT) AS last_sequence, 'peer:1' AS peer_address,
            CAST(7 AS BIGINT) AS updated_at FROM crumbs""",
        "codec_round_trip": "SELECT sequence, timestamp, origin_service, event_type, payload FROM log WHERE sequence % 100 > 1",
        "corrupt_rows": """SELECT CASE sequence % 100 WHEN 0 THEN '1|100|1|svc|a|b|x' ELSE 'bad' END AS value, count(*) AS n
            FROM log WHERE sequence % 100 <= 1 GROUP BY 1""",
        "log_round_trip": """SELECT 'evt:' || origin_service || ':' || kind || ':' || printf('%016x', sequence) AS key, sequence, kind AS event_type,
            payload, timestamp, origin_service FROM (SELECT *, CASE WHEN sequence % 7 = 0 THEN '' ELSE event_type END AS kind FROM log)""",
        "log_batches": """SELECT CAST(CASE WHEN sequence % 5 = 4 THEN 0 ELSE 1 END AS INTEGER) AS level, CAST(1 AS BIGINT) AS batches,
            count(*) AS num_entries FROM log GROUP BY 1""",
        "kv_put_get": """SELECT bk AS key, printf('%012d', sequence) AS value FROM log WHERE starts_with(bk, 'svc-1:')
            QUALIFY row_number() OVER (PARTITION BY bk ORDER BY sequence % 2, sequence DESC) = 1""",
    }.items()
}
