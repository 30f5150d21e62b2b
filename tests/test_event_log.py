"""Operators, codecs, the durable log, recovery and the streaming pull."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from eventloom import catalog, service
from eventloom.functions import codec
from eventloom.model import CURSOR_SCHEMA, EVENT_SCHEMA, Contract, EventError, ServiceIdentity
from eventloom.operators import contracts, merge, scan
from eventloom.operators.sequences import number_rows
from eventloom.plans import recovery
from eventloom.sources.config import load_config, parse_address, parse_config
from eventloom.sources.event_log import EventLog
from eventloom.streaming.pull import ingest_batch, start_pull

ME = ServiceIdentity("me", "i1", "127.0.0.1:1")
ORDERS = Contract("order-service", ("order.created", "order.updated"), "10.0.0.1:5")


def events(spark, rows):
    return spark.createDataFrame([(s, t, p, 1, o) for o, t, s, p in rows], EVENT_SCHEMA)


def seqs(df):
    return [r.sequence for r in df.collect()]


@pytest.fixture
def store(spark, tmp_path):
    return EventLog(spark, str(tmp_path / "log"), ME, [ORDERS])


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_match_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf_dir}/events.parquet')")
    cursor = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    got = catalog.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))


def test_ordered_suffix_and_isolation(spark, store):
    rows = [("order-service", "order.created", s, "x") for s in (5, 3, 9, 1, 7, 2, 8, 10, 4, 6)] + [("user-service", "user.registered", 1, "y")]
    store.append(events(spark, rows))
    assert seqs(store.query_events("order-service", "order.created")) == list(range(1, 11))
    assert seqs(store.query_events("order-service", "order.created", 7)) == [7, 8, 9, 10]
    assert seqs(store.query_events("order-service", "order.created", 7, 2)) == [7, 8]
    assert store.query_events("ghost-service", "order.created").count() == 0
    assert store.scan_prefix("evt:order-service:").count() == 10
    assert store.scan_prefix("evt:order-service:order.created:").count() == 10
    assert store.contains("evt:user-service:user.registered:0000000000000001") and not store.contains("evt:x")


def test_overwrite_compaction_and_restart(spark, store):
    store.append(events(spark, [("a", "t", 1, "first"), ("a", "t", 2, "kept")]))
    store.append(events(spark, [("a", "t", 1, "second")]))
    for _ in range(2):
        again = EventLog(spark, store.path, ME, [ORDERS])
        assert {r.sequence: r.payload for r in again.events().collect()} == {1: "second", 2: "kept"}
        store.compact()
        store.vacuum()
    assert store.batches().count() == 1 and store.stats().first().num_keys == 2
    store.destroy()
    assert store.events().count() == 0


def test_empty_fields_pipes_and_bad_names(spark, store):
    table = events(spark, [("a", "", 1, ""), ("", "t", 1, "x"), ("", "", 5, "y"), ("a", "t", 2, "a|b|c"), ("a", "t", 3, "né|é"), ("a", "t=/%", 2**62, "big")])
    store.append(table)
    got = store.events()
    assert sorted(map(tuple, got.select(*table.columns).collect())) == sorted(map(tuple, table.collect()))
    assert got.where("event_type = '' AND origin_service = 'a'").first().key == "evt:a::0000000000000001"
    for origin, event_type, n in (("a", "", 1), ("", "t", 1), ("", "", 1), ("a", "t", 2), ("a", "t=/%", 1)):
        assert store.query_events(origin, event_type).count() == n
    anyone = EventLog(spark, store.path)
    assert anyone.ingest(table)["inserted"] == 0 and anyone.versions().count() == 6
    assert store.get("evt:a::0000000000000001").count() == 1 and store.scan_prefix("evt:::").count() == 1
    for bad in ([("a:b", "t", 1, "")], [("a", "t|u", 1, "")], [("a", "t", -1, "")]):
        with pytest.raises(EventError):
            store.append(events(spark, bad))
    assert store.events().count() == 6


def test_levels_of_batches(spark, store):
    for n in range(17):
        store.append(events(spark, [("a", "t", 1, f"{n}"), ("a", "t", 2 + n, "x")]))
    assert sorted((r.level, r.rows) for r in store.batches().collect()) == [(0, 2), (2, 17)]
    assert store.get("evt:a:t:0000000000000001").first().payload == "16" and store.stats().first().num_entries == 18
    store.vacuum()
    assert store.events().count() == 18 and EventLog(spark, store.path).versions().count() == 19


def test_free_form_keys(spark, store):
    rows = lambda *r: spark.createDataFrame(list(r), "key string, value string")
    assert store.values().count() == 0
    store.put_values(rows(("user:1", "a"), ("user:2", "b"), ("edge:-_.@", "c"), ("", "empty")))
    store.put_values(rows(("user:1", "newer"), ("user:10", "d"), ("user:10", "c")))
    store.append(events(spark, [("a", "t", 1, "x")]))
    assert [tuple(r) for r in store.scan_values("user:").collect()] == [("user:1", "newer"), ("user:10", "d"), ("user:2", "b")]
    assert store.get_value("edge:-_.@").first().value == "c" and store.get_value("").count() == 1 and store.get_value("no").count() == 0
    store.vacuum()
    assert store.values().count() == 5 and store.events().count() == 1


def test_unfinished_version_is_not_read(spark, store):
    store.append(events(spark, [("a", "t", 1, "x")]))
    (pathlib.Path(store.path) / "versions" / "000000000002.json").write_text('{"batches": [')
    assert store.events().count() == 1
    with pytest.raises(EventError, match="another writer"):
        store.append(events(spark, [("a", "t", 2, "x")]))
    assert store.repair() == 1 and store.repair() == 0
    store.append(events(spark, [("a", "t", 2, "x")]))
    assert store.events().count() == 2


def test_batches_of_keys_are_merged(spark, store):
    one = lambda k, v: spark.createDataFrame([(k, v)], "key string, value string")
    for n in range(5):
        store.put_values(one("same", f"v{9 - n}"))
    assert sorted(b["level"] for b in store._state()["keys"]) == [0, 1]
    store.put_values(one("other", "x"))
    store.compact()
    store.put_values(one("other", "y"))
    store.vacuum()
    assert sorted(b["level"] for b in store._state()["keys"]) == [0, 1] and store.versions().count() == 0
    assert sorted(map(tuple, store.values().collect())) == [("other", "y"), ("same", "v5")]


def test_ingest_rules(spark, store):
    first = store.ingest(events(spark, [("order-service", "order.created", 1, "first")]))
    again = store.ingest(events(spark, [("order-service", "order.created", 1, "second"), ("me", "own", 1, "x"), ("other", "order.created", 1, "y")]))
    assert first == {"pulled": 1, "inserted": 1, "rejected": 0, "duplicate": 0}
    assert again == {"pulled": 3, "inserted": 1, "rejected": 1, "duplicate": 1}
    assert store.get("evt:order-service:order.created:0000000000000001").first().payload == "first"
    for row in (("unknown-service", "order.created", 1, ""), ("order-service", "order.deleted", 1, "")):
        with pytest.raises(EventError, match="UnauthorizedOrigin"):
            store.ingest(events(spark, [row]), strict=True)
    anyone = EventLog(spark, store.path + "-open")
    assert anyone.ingest(events(spark, [("unknown", "t", 1, "")]))["inserted"] == 1


def test_local_sequences(spark, store):
    rows = spark.createDataFrame([("created", "a", 1), ("created", "b", 2), ("registered", "c", 3)], "event_type string, payload string, arrival int")
    assert sorted((r.sequence, r.payload) for r in store.append_local(rows).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    more = EventLog(spark, store.path, ME).append_local(rows.limit(1))
    assert seqs(more) == [4]
    with pytest.raises(EventError, match="NoIdentity"):
        EventLog(spark, store.path).append_local(rows)


def test_second_writer_fails(spark, store):
    stale = store._state()
    store.append(events(spark, [("a", "t", 1, "x")]))
    with pytest.raises(EventError, match="another writer"):
        store._commit(stale)


def cursors(spark, rows):
    return spark.createDataFrame([(*r, "10.0.0.1:5", 1) for r in rows], CURSOR_SCHEMA)


def test_recovery_plan_and_cursors(spark, store):
    contracts = store.contracts
    plan = lambda c: sorted(tuple(r)[1:] for r in recovery.plan_for(contracts, c).collect())
    assert plan(store.cursors()) == [("order-service", "order.created", 0), ("order-service", "order.updated", 0)]
    store.put_cursors(cursors(spark, [("order-service", "order.created", 42), ("x", "y", 1)]))
    store.put_cursors(cursors(spark, [("order-service", "order.created", 40)]))  # backwards
    assert plan(store.cursors()) == [("order-service", "order.created", 41), ("order-service", "order.updated", 0)]
    assert store.cursors().count() == 2 and store.get_cursor("x", "y").first().last_sequence == 1
    assert recovery.plan_for(contracts.limit(0), store.cursors()).count() == 0
    assert store.events().count() == 0


def test_recovery_from_peers(spark, store, tmp_path):
    peer = EventLog(spark, str(tmp_path / "peer"), ServiceIdentity("order-service", "p", "10.0.0.1:5"))
    peer.append(events(spark, [("order-service", "order.created", s, str(s)) for s in (1, 2)] + [("else", "order.created", 3, "no")]))
    assert store.recover({}) == {"10.0.0.1:5": None}
    assert store.recover({"10.0.0.1:5": peer})["10.0.0.1:5"]["inserted"] == 2
    assert store.get_cursor("order-service", "order.created").first().last_sequence == 2
    assert store.recover({"10.0.0.1:5": peer})["10.0.0.1:5"]["pulled"] == 0
    assert seqs(peer.serve("order.created", 2)) == [2]
    peer.append(events(spark, [("order-service", "order.created", 3, "3")]))
    for part in (pathlib.Path(peer.path) / "data").rglob("*.parquet"):
        part.write_bytes(b"broken")
    assert store.recover({"10.0.0.1:5": peer}) == {"10.0.0.1:5": None}
    assert store.get_cursor("order-service", "order.created").first().last_sequence == 2


def test_highest_ingested(spark, store):
    batch = events(spark, [("order-service", "order.created", 4, "x"), ("order-service", "order.deleted", 9, "no")])
    at = cursors(spark, [("order-service", "order.created", 7), ("order-service", "order.deleted", 9)])
    store.ingest(batch, at, highest_ingested=True)
    assert [(r.event_type, r.last_sequence) for r in store.cursors().collect()] == [("order.created", 4)]
    store.ingest(batch, at)
    assert store.get_cursor("order-service", "order.created").first().last_sequence == 7


def test_streaming_pull_is_idempotent(spark, store, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    batch = events(spark, [("order-service", "order.created", s, str(s)) for s in (1, 2, 3)] + [("other", "t", 1, "no")])
    batch.write.parquet(source)
    start_pull(store, source, state).awaitTermination()
    assert seqs(store.query_events("order-service", "order.created")) == [1, 2, 3]
    assert ingest_batch(store, batch)["inserted"] == 0  # the batch runs again
    events(spark, [("order-service", "order.created", 4, "4"), ("order-service", "order.created", 2, "late")]).write.mode("append").parquet(source)
    start_pull(store, source, state).awaitTermination()
    assert seqs(store.query_events("order-service", "order.created")) == [1, 2, 3, 4]
    assert store.get("evt:order-service:order.created:0000000000000002").first().payload == "2"


def test_codecs(spark):
    table = events(spark, [("svc", "t", 7, "a|b|c"), ("svc", "", 8, ""), ("svc", "t", 9, "né")])
    coded = table.select(codec.encode_event().alias("value"))
    assert coded.first()[0] == "7|1|5|svc|t|a|b|c"
    bad = spark.createDataFrame([("bad",), ("1|100|1|svc|a|b|x",), (" 1|1|0|s|t|",), ("",), (None,)], "value string")
    decoded = codec.decode_events(coded.union(bad))
    assert codec.valid_events(decoded).select(*table.columns).exceptAll(table).count() == 0
    assert codec.valid_events(decoded).count() == 3 and codec.corrupt_rows(decoded).count() == 5
    assert table.select(codec.event_key()).first()[0] == "evt:svc:t:0000000000000007"
    strict = spark.createDataFrame([("7\n|1|0|s|t|",), ("-5|1|0|s|t|",), ("5|1|-0|s|t|",), ("5|-1|0|s|t|",)], "value string")
    assert [r.valid for r in codec.decode_events(strict).collect()] == [False, False, False, True]


def test_merge_prefers_newer_runs(spark):
    runs = [spark.createDataFrame(r, "key string, sequence long") for r in ([("a", 1), ("b", 99), ("c", 3)], [("b", 20), ("d", 40)])]
    assert {r.key: r.sequence for r in merge.merge_runs(merge.union_runs(runs)).collect()} == {"a": 1, "b": 20, "c": 3, "d": 40}


def test_number_rows_across_partitions(spark):
    rows = [(k % 3 if k % 3 else None, (k * 7919) % 5003, k) for k in range(5000)]
    got = number_rows(spark.createDataFrame(rows, "k long, at long, id long"), ["k"], ["at"])
    assert got.columns == ["k", "at", "id", "number"]
    for key in (None, 1, 2):
        own = sorted((r.at, r.number) for r in got.collect() if r.k == key)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    assert number_rows(spark.createDataFrame([], "k long, at long"), ["k"], ["at"]).count() == 0


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_log_plans(spark, store, tmp_path):
    """Lookups prune partitions and push sequences; batches are one scan; contracts and tasks shuffle nothing."""
    for n in range(3):
        store.append(events(spark, [("a", "t", n, "x"), ("b", "u", n, "y")]))
    for found in (plan_of(store.get("evt:a:t:0000000000000001")), plan_of(store.query_events("a", "t", 1))):
        assert found.count("FileScan") == 1 and "origin_part#" in found.split("PartitionFilters")[1].split("PushedFilters")[0]
        assert "(sequence,1)" in found.split("PushedFilters")[1]
    path = str(tmp_path / "flat")
    store.events().write.parquet(path)
    flat, pairs = spark.read.parquet(path), spark.createDataFrame([("a", "t", "p")], "source_service string, event_type string, peer_address string")
    for df in (contracts.authorize(flat, pairs, "me"), contracts.reject(flat, pairs, "me"), recovery.recovery_pull(recovery.recovery_plan(pairs, store.cursors()), flat)):
        text = plan_of(df)
        assert "Exchange" not in text and "origin_service" in text.split("PushedFilters")[1]
    text = plan_of(scan.point_get(flat, "evt:a:t:0000000000000001"))
    assert "EqualTo(sequence,1)" in text and "EqualTo(event_type,t)" in text
    found = scan.contains(flat, spark.createDataFrame([("evt:a:t:0000000000000001",), ("evt:a:t:0000000000000009",)], "key string"))
    assert sorted(map(tuple, found.collect())) == [("evt:a:t:0000000000000001", True), ("evt:a:t:0000000000000009", False)]


def test_many_contracts_are_joined(spark, monkeypatch):
    monkeypatch.setattr(contracts, "FEW", 1)
    monkeypatch.setattr(recovery, "FEW", 1)
    table = events(spark, [("a", "t", 1, "x"), ("b", "t", 2, "y"), ("c", "t", 3, "z"), ("me", "t", 4, "w")])
    pairs = spark.createDataFrame([("a", "t", "p"), ("b", "t", "p"), (None, "t", "p")], "source_service string, event_type string, peer_address string")
    assert sorted(seqs(contracts.authorize(table, pairs, "me"))) == [1, 2, 4] and seqs(contracts.reject(table, pairs, "me")) == [3]
    plan = pairs.dropna().withColumn("from_sequence", F.lit(2).cast("long"))
    assert seqs(recovery.recovery_pull(plan, table)) == [2]


def test_service(spark, tmp_path):
    peer = EventLog(spark, str(tmp_path / "peer"), ServiceIdentity("o", "", "1.2.3.4:6"))
    peer.append(events(spark, [("o", "a", 1, "x"), ("o", "b", 2, "y"), ("o", "c", 3, "z")]))
    events(spark, [("o", "a", 2, "more"), ("o", "a", 1, "late")]).write.parquet(str(tmp_path / "in"))
    config = {"service_name": "s", "instance_id": "i", "listen_address": "1.2.3.4:5", "wal_path": str(tmp_path / "own"),
              "contracts": [{"source_service": "o", "event_types": ["a", "b"], "peer_address": "1.2.3.4:6"}]}
    (tmp_path / "c.json").write_text(json.dumps(config))
    report = service.run(spark, str(tmp_path / "c.json"), {"1.2.3.4:6": ("o", peer.path)}, str(tmp_path / "in"))
    assert report["1.2.3.4:6"]["inserted"] == 2
    assert sorted((r.event_type, r.sequence, r.payload) for r in EventLog(spark, str(tmp_path / "own")).events().collect()) == [("a", 1, "x"), ("a", 2, "more"), ("b", 2, "y")]


def test_filters_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = scan.query_events(spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("sequence"), F.col("o_orderstatus").alias("event_type"), F.col("o_orderpriority").alias("origin_service")), "a", "b", 7)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,7)" in text and "EqualTo(o_orderstatus,b)" in text


def test_config(tmp_path):
    whole = {"service_name": "s", "instance_id": "i", "listen_address": "1.2.3.4:5", "wal_path": "x.wal",
             "contracts": [{"source_service": "o", "event_types": ["a", "b"], "peer_address": "1.2.3.4:6"}]}
    (tmp_path / "c.json").write_text(json.dumps(whole))
    config = load_config(str(tmp_path / "c.json"))
    assert config.contracts[0].event_types == ("a", "b") and config.identity.name == "s"
    for broken in ({**whole, "more": 1}, {k: v for k, v in whole.items() if k != "wal_path"}, {**whole, "contracts": [{"source_service": 1}]}):
        with pytest.raises(EventError):
            parse_config(json.dumps(broken))
    with pytest.raises(EventError):
        parse_config("")
    assert parse_address("127.0.0.1:80") == ("127.0.0.1", 80) and parse_address("127.0.0.1") == ("127.0.0.1", 0)
    for bad in ("host:1", "1.2.3.4:99999", "1.2.3.4:x"):
        with pytest.raises(EventError):
            parse_address(bad)
