"""A durable event log: Parquet batches and a list of those that are live.

A commit writes its batch first and then one file of the next version, which names all live
batches and the cursor table. A reader sees a version as a whole, and a crash before that file is
complete leaves the log as it was. Batches are partitioned by origin and type and sorted
by sequence, so scans prune partitions and row groups. Partition names carry a prefix,
as an empty name can't be told from a null one in a path; the files hold the names as they are.

Every four batches of a level become one of the next, so the number of files
grows with the logarithm of the writes, and a row is rewritten as seldom.

There is one writer at a time: a second one fails when it finds its version taken, as a version's
file is created without overwriting. `repair` clears a version that a stopped writer left unfinished.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.codec import event_key
from eventloom.model import CONTRACT_SCHEMA, CURSOR_SCHEMA, EVENT_COLUMNS, EVENT_KEY, EVENT_SCHEMA, Contract, EventError, ServiceIdentity, is_valid_event
from eventloom.operators import scan, stats
from eventloom.operators.contracts import FEW, any_of, authorize, explode_contracts
from eventloom.operators.merge import first_per_key, newest_per_key, not_stored
from eventloom.operators.sequences import assign_sequences
from eventloom.plans import recovery

_STORED = EVENT_SCHEMA.replace(" NOT NULL", "") + ", write_order BIGINT, batch_order BIGINT, batch STRING, origin_part STRING, type_part STRING"
_KEY_VALUES = "key STRING, value STRING, write_order BIGINT, batch STRING"
#: Batches of a level that become one of the next.
MERGED = 4


def _part(name: str) -> str:
    return f"n.{name}"


def _in_stream(origin: str, event_type: str | None = None) -> Column:
    """A condition on partitions, and on the columns that they stand for."""
    whole = (F.col("origin_part") == _part(origin)) & (F.col("origin_service") == origin)
    return whole if event_type is None else whole & (F.col("type_part") == _part(event_type)) & (F.col("event_type") == event_type)


class EventLog:
    """Events, free-form keys, consumer cursors and contracts of one service (or of none).

    `merged` is the number of batches of a level that become one; 0 leaves that to `compact`.
    """

    def __init__(self, spark: SparkSession, path: str, identity: ServiceIdentity | None = None, contracts: Iterable[Contract] = (), merged: int = MERGED):
        self.spark, self.path, self.identity, self.merged = spark, path.rstrip("/"), identity, merged
        self.contracts = spark.createDataFrame([c.row() for c in contracts], CONTRACT_SCHEMA)
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- versions

    def _versions(self) -> list[int]:
        folder = self._jvm.Path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _state(self) -> dict:
        """The newest version that was written to its end."""
        for version in reversed(self._versions()):
            rows = self.spark.read.text(f"{self.path}/versions/{version:012d}.json", wholetext=True).take(1)
            try:
                return json.loads(rows[0][0]) | {"version": version}
            except (IndexError, ValueError):
                continue  # a writer stopped, or is about to end it
        return {"version": 0, "batches": [], "keys": [], "cursors": None, "writes": 0}

    def _commit(self, state: dict) -> None:
        version = max([state["version"], 0]) + 1
        try:
            out = self._fs.create(self._jvm.Path(f"{self.path}/versions/{version:012d}.json"), False)
        except Py4JJavaError as taken:
            raise EventError(f"another writer has taken version {version}") from taken
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    def _write(self, events: DataFrame, state: dict, order: str = "sequence", level: int = 0) -> tuple[dict, int]:
        """Write a batch; the state with it, and its rows. The order within it is `order`."""
        name = f"{state['writes'] + 1:012d}-{uuid.uuid4().hex}"
        rows = events.select(
            *EVENT_COLUMNS, F.lit(state["writes"] + 1).cast("long").alias("write_order"), F.col(order).cast("long").alias("batch_order"),
            F.concat(F.lit("n."), "origin_service").alias("origin_part"), F.concat(F.lit("n."), "event_type").alias("type_part"),
        )
        rows.sortWithinPartitions(*EVENT_KEY).write.partitionBy("origin_part", "type_part").parquet(f"{self.path}/data/batch={name}")
        written = self._read([name]).count()
        entry = {"name": name, "level": level, "rows": written}
        return state | {"batches": [*state["batches"], entry], "writes": state["writes"] + 1}, written

    def _read(self, names: list[str]) -> DataFrame:
        """All rows of the batches, in one scan."""
        paths = [f"{self.path}/data/batch={n}" for n in names if self._fs.exists(self._jvm.Path(f"{self.path}/data/batch={n}"))]
        if not paths:
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.schema(_STORED).option("basePath", f"{self.path}/data").parquet(*paths)

    def _merge_levels(self, state: dict) -> dict:
        """Batches of a level are merged when they are enough; higher levels hold older writes."""
        while found := self._full_level(state["batches"]):
            kept, own, level = found
            state = self._rewrite(state, kept, own, level)
        return state

    def _full_level(self, batches: list[dict]) -> tuple[list[dict], list[dict], int] | None:
        """Batches that stay, those to merge, and their level, if a level has enough of them."""
        levels = [b["level"] for b in batches]
        full = min((n for n in set(levels) if self.merged and levels.count(n) >= self.merged), default=None)
        if full is None:
            return None
        return [b for b in batches if b["level"] > full], [b for b in batches if b["level"] <= full], full + 1

    def _rewrite(self, state: dict, kept: list[dict], own: list[dict], level: int) -> dict:
        rows = self._visible(self._read([b["name"] for b in own]))
        spread = rows.repartition("origin_service", "event_type", F.floor(F.col("sequence") / 1_000_000))
        return self._write(spread, state | {"batches": kept}, level=level)[0]

    # ---- reading

    def batches(self) -> DataFrame:
        """The live batches: name, level and rows."""
        return self.spark.createDataFrame([(b["name"], b["level"], b["rows"]) for b in self._state()["batches"]], "name string, level int, rows long")

    def versions(self, where: Column | None = None) -> DataFrame:
        """All stored rows, shadowed ones too, of the partitions that `where` names."""
        rows = self._read([b["name"] for b in self._state()["batches"]])
        return (rows if where is None else rows.where(where)).drop("batch", "origin_part", "type_part")

    def _visible(self, versions: DataFrame) -> DataFrame:
        return newest_per_key(versions.withColumn("order", F.struct("write_order", "batch_order")), EVENT_KEY, "order").select(*EVENT_COLUMNS)

    def events(self, where: Column | None = None) -> DataFrame:
        """The visible event of each key, with the key."""
        return self._visible(self.versions(where)).select(event_key().alias("key"), *EVENT_COLUMNS)

    def query_events(self, origin: str, event_type: str, from_sequence: int = 0, max_count: int = 0) -> DataFrame:
        return scan.query_events(self.events(_in_stream(origin, event_type)), origin, event_type, from_sequence, max_count)

    def scan_prefix(self, prefix: str) -> DataFrame:
        """Events whose key starts with `prefix`; a whole stream's prefix prunes partitions."""
        stream = scan.parse_event_prefix(prefix)
        return scan.scan_prefix(self.events(_in_stream(*stream) if stream else None), prefix)

    def get(self, key: str) -> DataFrame:
        parts = scan.parse_event_key(key)
        return scan.point_get(self.events(_in_stream(*parts[:2]) & (F.col("sequence") == parts[2]) if parts else None), key)

    def contains(self, key: str) -> bool:
        return not self.get(key).limit(1).isEmpty()

    def stats(self) -> DataFrame:
        return stats.store_stats(self.events())

    def cursors(self) -> DataFrame:
        name = self._state()["cursors"]
        if not name:
            return self.spark.createDataFrame([], CURSOR_SCHEMA)
        return self.spark.read.schema(CURSOR_SCHEMA).parquet(f"{self.path}/cursors/{name}")

    def get_cursor(self, source: str, event_type: str) -> DataFrame:
        return self.cursors().where((F.col("source_service") == source) & (F.col("event_type") == event_type))

    # ---- free-form keys

    def put_values(self, rows: DataFrame) -> None:
        """Store values under keys of any form (key, value); the last write of a key is the visible one.

        Of a key that `rows` holds several times the greatest value counts.
        """
        values = rows.where("key IS NOT NULL").groupBy("key").agg(F.max("value").alias("value"))
        state = self._write_values(values, self._state())
        while found := self._full_level(state["keys"]):
            kept, own, level = found
            state = self._write_values(self._values(own), state | {"keys": kept}, level)
        self._commit(state)

    def _write_values(self, values: DataFrame, state: dict, level: int = 0) -> dict:
        name, order = f"{state['writes'] + 1:012d}-{uuid.uuid4().hex}", state["writes"] + 1
        rows = values.select("key", "value", F.lit(order).cast("long").alias("write_order"))
        rows.sortWithinPartitions("key").write.parquet(f"{self.path}/keys/batch={name}")
        return state | {"keys": [*state["keys"], {"name": name, "level": level}], "writes": order}

    def values(self, where: Column | None = None) -> DataFrame:
        """The visible value of each key."""
        return self._values(self._state()["keys"], where)

    def _values(self, batches: list[dict], where: Column | None = None) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], "key STRING, value STRING")
        rows = self.spark.read.schema(_KEY_VALUES).option("basePath", f"{self.path}/keys").parquet(*[f"{self.path}/keys/batch={b['name']}" for b in batches])
        return newest_per_key(rows if where is None else rows.where(where)).select("key", "value")

    def get_value(self, key: str) -> DataFrame:
        return self.values(F.col("key") == key)

    def scan_values(self, prefix: str) -> DataFrame:
        return self.values(F.col("key").startswith(prefix)).orderBy("key")

    # ---- writing

    def _checked(self, events: DataFrame) -> DataFrame:
        if not events.where(~is_valid_event()).isEmpty():
            raise EventError("invalid events: nulls, ':' or '|' in a name, a negative sequence, or too large a payload")
        return events

    def _staged(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """`rows`, evaluated once: what a source gives later is not looked at."""
        path = f"{self.path}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), path

    def _drop_staged(self, path: str) -> None:
        self._fs.delete(self._jvm.Path(path), True)

    def append(self, events: DataFrame) -> int:
        """Write events under their own keys; the last write of a key is the visible one."""
        staged, path = self._staged(events.select(*EVENT_COLUMNS))
        try:
            state, written = self._write(self._checked(staged), self._state())
            self._commit(self._merge_levels(state))
            return written
        finally:
            self._drop_staged(path)

    def append_local(self, arrivals: DataFrame, order: str = "arrival") -> DataFrame:
        """Give own events (event_type, payload and an order) the next sequence numbers; returns what was written."""
        if self.identity is None:
            raise EventError("NoIdentity")
        own, state = self.identity.name, self._state()
        last = stats.max_sequence(self.versions(_in_stream(own)))
        rows = arrivals.withColumn("origin_service", F.lit(own)).withColumn("timestamp", F.lit(int(time.time())).cast("long"))
        state, _ = self._write(self._checked(assign_sequences(rows, last, order)), state)
        fresh = state["batches"][-1]["name"]
        self._commit(self._merge_levels(state))
        return self._read([fresh]).select(*EVENT_COLUMNS)

    def _stored_near(self, events: DataFrame) -> DataFrame:
        """Stored rows of the streams and of the range of sequence numbers that `events` has."""
        ends = events.agg(F.min("sequence"), F.max("sequence")).first()
        if ends[0] is None:
            return self.versions(F.lit(False))
        streams = events.select("origin_service", "event_type").distinct().take(FEW + 1)
        near = F.col("sequence").between(*ends)
        return self.versions(near & any_of([_in_stream(*s) for s in streams]) if len(streams) <= FEW else near)

    def ingest(self, events: DataFrame, cursors: DataFrame | None = None, strict: bool = False, order: str = "sequence", highest_ingested: bool = False) -> dict[str, int]:
        """Take in events of others once: the first write of a key stays.

        Events and cursors become visible in one commit. `strict` refuses a batch that has
        events without a contract; else they are left out and counted. Cursors of streams go as
        far as `cursors` says or, with `highest_ingested`, as far as the stream's events were taken in.
        """
        state, own = self._state(), self.identity.name if self.identity else None
        names = [*EVENT_COLUMNS, *([order] if order not in EVENT_COLUMNS else [])]
        staged, path = self._staged(events.select(*names))
        try:
            allowed = authorize(staged, explode_contracts(self.contracts), own)
            total, accepted = staged.count(), allowed.count()
            if strict and total > accepted:
                raise EventError("UnauthorizedOrigin")
            self._checked(allowed)
            fresh = not_stored(first_per_key(allowed, EVENT_KEY, order), self._stored_near(allowed), EVENT_KEY)
            state, inserted = self._write(fresh, state, order)
            if cursors is not None:
                if highest_ingested:
                    taken = allowed.groupBy(F.col("origin_service").alias("source_service"), "event_type").agg(F.max("sequence").alias("taken"))
                    cursors = cursors.join(taken, ["source_service", "event_type"]).withColumn("last_sequence", F.col("taken")).drop("taken")
                state = self._with_cursors(cursors, state)
            self._commit(self._merge_levels(state))
            return {"pulled": total, "inserted": inserted, "rejected": total - accepted, "duplicate": accepted - inserted}
        finally:
            self._drop_staged(path)

    def _with_cursors(self, cursors: DataFrame, state: dict) -> dict:
        keys = ["source_service", "event_type"]
        name = f"cursors-{uuid.uuid4().hex}"
        columns = [c.split()[0] for c in CURSOR_SCHEMA.split(", ")]
        kept = not_stored(self.cursors(), cursors, keys)
        kept.select(*columns).unionByName(cursors.select(*columns)).write.parquet(f"{self.path}/cursors/{name}")
        return state | {"cursors": name}

    def put_cursors(self, cursors: DataFrame) -> None:
        """The last write of a (source, type) wins; a cursor may move backwards."""
        self._commit(self._with_cursors(cursors, self._state()))

    def compact(self) -> None:
        """Rewrite the visible events as one batch, and the visible values of keys as one. Older files go with `vacuum`."""
        state = self._state()
        if state["batches"]:
            state = self._rewrite(state, [], state["batches"], max(b["level"] for b in state["batches"]))
        if len(state["keys"]) > 1:
            state = self._write_values(self.values(), state | {"keys": []}, max(b["level"] for b in state["keys"]))
        if state["batches"] or state["keys"]:
            self._commit(state)

    def repair(self) -> int:
        """Delete newer versions that a writer left unfinished when it stopped; returns how many.

        Until then writers find such a version taken. Call it only when no writer is at work.
        """
        newest = self._state()["version"]
        left = [v for v in self._versions() if v > newest]
        for version in left:
            self._fs.delete(self._jvm.Path(f"{self.path}/versions/{version:012d}.json"), False)
        return len(left)

    def vacuum(self) -> None:
        """Delete batches and cursor tables that the newest version no longer names."""
        state = self._state()
        live = {*(f"batch={b['name']}" for b in state["batches"]), *(f"batch={b['name']}" for b in state["keys"]), state["cursors"]}
        for folder in ("data", "keys", "cursors", "staged"):
            at = self._jvm.Path(f"{self.path}/{folder}")
            for entry in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if entry.getPath().getName() not in live:
                    self._fs.delete(entry.getPath(), True)

    def destroy(self) -> None:
        self._fs.delete(self._jvm.Path(self.path), True)

    # ---- recovery

    def serve(self, event_type: str, from_sequence: int = 0, max_count: int = 0) -> DataFrame:
        """What a peer may pull: own events only."""
        if self.identity is None:
            raise EventError("NoIdentity")
        return self.query_events(self.identity.name, event_type, from_sequence, max_count)

    def recover(self, peers: dict[str, EventLog], highest_ingested: bool = False) -> dict[str, dict[str, int] | None]:
        """Pull what the contracts ask of each peer address; None for a peer that is absent or can't be read."""
        plan = recovery.plan_for(self.contracts, self.cursors())
        report: dict[str, dict[str, int] | None] = {}
        for (address,) in plan.select("peer_address").distinct().collect():
            peer, tasks = peers.get(address), plan.where(F.col("peer_address") == address)
            report[address] = None
            if peer is None or peer.identity is None:
                continue
            try:
                offered = peer.events(_in_stream(peer.identity.name)).drop("key")
                pulled, path = self._staged(recovery.recovery_pull(tasks, offered))
            except (PySparkException, Py4JJavaError):
                continue  # what the peer holds can't be read: the next recovery asks again
            try:
                report[address] = self.ingest(pulled, recovery.advanced_cursors(pulled, tasks, int(time.time())), highest_ingested=highest_ingested)
            finally:
                self._drop_staged(path)
        return report
