from datetime import datetime, timedelta

import pytest

from tidelog.operators import eventlog, maintenance
from tidelog.streaming import metrics as m
from tidelog.streaming.delivery import Delivery, TableLog, key_of
from tidelog.functions import keys
from tidelog.streaming.runner import Background, Gate, position_lost, recover_position, skip_history, start_capture, start_delivery, supervise
from tidelog.streaming.sinks import FailableSink, HttpSink, MemorySink, SinkError, make_sink
from tidelog.streaming.state import PositionLedger, StateStore

DAY = datetime(2024, 3, 15)


def events(n, stream=1):
    return [{"id": f"e{i:03}", "created_at": DAY + timedelta(seconds=i), "payload": f'{{"seq": {i}}}', "stream_id": stream} for i in range(n)]


class ListLog:
    def __init__(self, rows, size=7):
        self.rows, self.size = rows, size

    def find(self, key):
        return next((e for e in self.rows if key_of(e) == key), None)

    def replay(self, start, end, inclusive):
        got = [e for e in self.rows if key_of(e) > start and (key_of(e) < end or inclusive and key_of(e) == end)]
        for i in range(0, len(got), self.size):
            yield got[i : i + self.size]


def machine(tmp_path, rows, *fail_on, store=None, **kw):
    sink = FailableSink(*fail_on)
    return Delivery(1, sink, ListLog(rows), store or StateStore(tmp_path), clock=lambda: DAY + timedelta(hours=1), **kw), sink


def ids(sink):
    return [e["id"] for e in sink.events()]


@pytest.mark.parametrize(
    "n, fail, batches, want",
    [
        (1, (0,), [0], []),
        (6, (1,), [0, 1, 5], [0, 1, 2, 3, 4, 5]),
        (3, (1,), [0, 1, 2], [0, 1, 2]),
        (5, (1, 2), [0, 1, 2, 4], [0, 1, 2, 3, 4]),
        (50, (1,), [0, 5, 49], [0, *range(5, 50)]),
        (5, (1, 2, 3), [0, 1, 2, 3, 4], [0, 1, 2, 3, 4]),
    ],
)
def test_failover_scripts(tmp_path, n, fail, batches, want):
    rows = events(n)
    d, sink = machine(tmp_path, rows, *fail)
    for i in batches:
        d.tick([rows[i]])
    assert ids(sink) == [f"e{i:03}" for i in want]
    assert d.state.healthy == bool(want)


def test_restart_in_failover(tmp_path):
    rows = events(3)
    d, _ = machine(tmp_path, rows, 1)
    d.tick([rows[0]])
    d.tick([rows[1]])
    again, sink = machine(tmp_path, rows)
    assert again.state.checkpoint == key_of(rows[1])
    again.tick([rows[2]])
    assert ids(sink) == ["e001", "e002"] and StateStore(tmp_path).load(1).healthy


def test_retry_without_new_data_and_failed_replay(tmp_path):
    rows = events(20)
    d, sink = machine(tmp_path, rows, 0, 1, 3)
    d.tick(rows[:3])
    d.tick(rows[3:20])  # withheld
    assert not ids(sink) and d.state.consumed == key_of(rows[19])
    assert d.retry() is False  # the event goes, the first replayed batch fails
    assert d.retry() is True
    got = ids(sink)
    assert sorted(set(got)) == [e["id"] for e in rows] and list(dict.fromkeys(got)) == sorted(set(got))
    assert d.metrics.value(m.ENTERED, stream_id=1) == d.metrics.value(m.RECOVERED, stream_id=1) == 1 and d.metrics.value(m.ACTIVE, stream_id=1) == 0


def test_late_key_in_the_current_batch_is_not_lost_or_repeated(tmp_path):
    rows = events(6)
    d, sink = machine(tmp_path, rows, 0)
    d.tick([rows[1]])
    d.tick([rows[0], rows[4]])  # commit order is not key order
    assert ids(sink) == ["e001", "e000", "e004"]  # the source has yet to pass on the others


def test_a_withheld_late_key_moves_the_checkpoint_back(tmp_path):
    rows = events(6)
    d, sink = machine(tmp_path, rows, 0, 1)
    d.tick([rows[3]])
    d.tick([rows[1], rows[4]])  # withheld, and begins before the checkpoint
    assert d.state.checkpoint == key_of(rows[1])
    d.tick([rows[5]])
    assert set(ids(sink)) == {e["id"] for e in rows[1:]} and d.state.healthy


@pytest.mark.parametrize("seed", range(6))
def test_no_event_is_lost_in_any_order_while_retries_fail(tmp_path, seed):
    import random

    rng = random.Random(seed)
    for n, size in ((8, 1), (9, 2), (12, 3)):
        rows = events(n)
        order = rng.sample(rows, n)
        parts = [order[i : i + size] for i in range(0, n, size)]
        for fail in range(len(parts)):
            for long in (1, 2, 3):
                store = StateStore(tmp_path / f"{seed}-{n}-{fail}-{long}")
                sink = FailableSink(*range(fail, fail + long))
                passed: list = []  # the log has what was committed so far
                log = ListLog(passed)
                d = Delivery(1, sink, log, store, clock=lambda: DAY + timedelta(hours=1))
                for k, part in enumerate(parts):
                    passed.extend(part)
                    passed.sort(key=key_of)
                    d.tick(part)
                    if rng.random() < 0.3:  # a restart in between
                        d = Delivery(1, sink, log, store, clock=lambda: DAY + timedelta(hours=1))
                while not d.retry():
                    pass
                assert set(ids(sink)) == {e["id"] for e in rows}, (n, size, fail, long)


def test_expired_checkpoint_resumes_after_it(tmp_path):
    rows = events(4)
    d, _ = machine(tmp_path, rows, 0)
    d.tick([rows[0]])
    d.log.rows, d._cached = rows[2:], None
    d.tick([rows[3]])
    assert ids(d.sink) == ["e002", "e003"] and d.metrics.value(m.EXPIRED, stream_id=1) == 1


def test_maintenance_is_scheduled_from_its_due_time(tmp_path):
    ran = []
    d, _ = machine(tmp_path, events(1), maintain=ran.append)
    d.state.next_maintenance_at = DAY
    d.tick([])
    d.tick([])
    assert len(ran) == 1 and d.state.next_maintenance_at == DAY + timedelta(hours=24)


def frame(spark, rows, lsn=lambda i: i):
    from decimal import Decimal

    data = [(e["id"], e["payload"], None, e["stream_id"], e["created_at"], None if lsn(i) is None else Decimal(lsn(i)), e["created_at"].date()) for i, e in enumerate(rows)]
    return spark.createDataFrame(data, eventlog.SCHEMA)


@pytest.mark.parametrize("n, a, b, want", [(1, 0, 0, 0), (5, 0, 4, 3), (10, 0, 1, 0), (10, 4, 9, 4)])
def test_replay_range_is_open(spark, n, a, b, want):
    rows = events(n)
    assert eventlog.replay_range(frame(spark, rows), 1, key_of(rows[a]), key_of(rows[b])).count() == want


def test_streams_are_isolated(spark):
    rows = [e | {"stream_id": 1 + i % 2} for i, e in enumerate(events(6))]
    assert eventlog.replay_range(frame(spark, rows), 1, key_of(rows[0]), key_of(rows[4])).count() == 1


def test_log_round_trip_lookup_batches_and_lsn(spark, tmp_path):
    path, rows = str(tmp_path / "log"), events(10)
    eventlog.append(frame(spark, rows, lambda i: i if i % 2 else None), path)
    log = eventlog.read(spark, path)
    assert eventlog.fetch(log, "e003", rows[3]["created_at"]).payload == '{"seq": 3}'
    with pytest.raises(eventlog.EventNotFound):
        eventlog.fetch(log, "e003", rows[4]["created_at"])
    assert [[r.id for r in p] for p in eventlog.batches(log, 4)] == [[f"e{i:03}" for i in x] for x in (range(4), range(4, 8), range(8, 10))]
    assert eventlog.first_after_lsn(log, 1, 3).first().id == "e005"
    assert eventlog.first_after_lsn(log, 1, 9, since=rows[7]["created_at"]).first().id == "e008"
    assert "event_date" in log.where("event_date = '2024-03-15'")._jdf.queryExecution().executedPlan().toString()


def pruned(df):
    """Whether the scan of a log's days is bounded."""
    text = df._jdf.queryExecution().executedPlan().toString()
    part = text[text.index("PartitionFilters: [") :].split("]")[0]
    return "event_date" in part and any(x in part for x in ("2024", ">=", "<=", " IN ", "="))


def test_log_operators_read_only_the_days_they_need(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [e | {"id": f"{d}-{e['id']}", "created_at": e["created_at"] + timedelta(days=d)} for d in range(6) for e in events(4)]
    eventlog.append(frame(spark, rows), path)
    log = eventlog.read(spark, path)
    a, b = key_of(rows[6]), key_of(rows[14])
    assert pruned(eventlog.point_lookup(log, a[1], a[0])) and pruned(eventlog.replay_range(log, 1, a, b)) and pruned(eventlog.first_after_lsn(log, 1, 9, no_earlier=rows[8]["created_at"]))
    assert eventlog.first_after_lsn(log, 1, 9, no_earlier=rows[8]["created_at"]).first().id == rows[10]["id"]
    states = spark.createDataFrame([(1, a[1], a[0]), (2, None, None), (3, "gone", b[0]), (4, b[1], b[0])], "id bigint, failover_checkpoint_id string, failover_checkpoint_ts timestamp")
    again = eventlog.resume(states, log)
    assert pruned(again) and {r.id: r.checkpoint_payload for r in again.collect()} == {1: '{"seq": 2}', 2: None, 3: None, 4: '{"seq": 2}'}
    assert eventlog.resume(states.where("id = 2"), log).first().checkpoint_payload is None
    assert eventlog.last_key(log, 1, a) == key_of(rows[-1]) and eventlog.last_key(log, 2, a) is None
    assert {len(p) for p in eventlog.batches(log, 7)} == {7, 3}


def test_a_batch_that_is_written_again_replaces_itself(spark, tmp_path):
    path, rows = str(tmp_path / "log"), events(6)
    eventlog.append(frame(spark, rows[:2]), path, "run-0")
    for _ in range(3):
        eventlog.append(frame(spark, rows[2:4]), path, "run-1")
    eventlog.append(frame(spark, rows[4:]), path)
    assert sorted(r.id for r in eventlog.read(spark, path).collect()) == [e["id"] for e in rows]


def test_conversion_of_rows(spark):
    good = frame(spark, events(2)).drop("event_date").selectExpr("lsn", "stream_id", "created_at", "payload", "id", "1 as extra")
    assert eventlog.convert(good).count() == 2
    with pytest.raises(Exception, match="Missing payload"):
        eventlog.convert(good.withColumn("payload", good.stream_id)).collect()


def test_streaming_delivery_with_a_table_log(spark, tmp_path):
    path, rows = str(tmp_path / "log"), events(30)
    sink = FailableSink(1)
    d = Delivery(1, sink, TableLog(lambda: eventlog.read(spark, path), 1, 10), StateStore(tmp_path / "s"))
    for part in (rows[:5], rows[5:12], rows[12:30]):
        eventlog.append(frame(spark, part), path)
        start_delivery(eventlog.read_stream(spark, path), d, str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert ids(sink) == [e["id"] for e in rows] and d.state.healthy


def test_position_loss(spark, tmp_path):
    rows, store = events(10), StateStore(tmp_path / "s")
    store.load(1)
    (tmp_path / "cp").mkdir()
    assert recover_position(spark, frame(spark, rows), store, 1, 4, str(tmp_path / "cp"))
    assert store.load(1).checkpoint == key_of(rows[5]) and store.load(1).consumed == key_of(rows[9]) and not (tmp_path / "cp").exists()
    assert recover_position(spark, frame(spark, rows), store, 1, None, str(tmp_path / "cp"), ledger=PositionLedger(tmp_path / "l")) and store.load(1).checkpoint == key_of(rows[1])
    sink = FailableSink()
    d = Delivery(1, sink, ListLog(rows), store)  # with the default clock
    d.tick([])
    d.tick([rows[9]])
    assert ids(sink) == [e["id"] for e in rows[1:]] and store.load(1).healthy
    assert position_lost("ERROR: Can No Longer Get Changes From Replication Slot x") and not position_lost("connection refused")
    calls = []

    class Query:
        def awaitTermination(self):
            calls.append(1)
            if len(calls) == 1:
                raise RuntimeError("can no longer get changes from replication slot")

    supervise(Query, lambda: calls.append("recovered"))
    assert calls == [1, "recovered", 1]
    tries = []

    class Broken:
        def awaitTermination(self):
            tries.append(1)
            raise RuntimeError("connection refused")

    with pytest.raises(RuntimeError, match="refused"):
        supervise(Broken, lambda: None, retries=2, pause=0.01)
    assert len(tries) == 3


def test_sinks():
    a = MemorySink()
    b = a.clone()
    b.publish([{"id": 1}])
    assert a.events() == [{"id": 1}]
    a.clear()
    assert not b.events() and make_sink({"type": "Memory"}).name() == "memory"
    with pytest.raises(ValueError):
        make_sink({"type": "none"})
    sent = []
    HttpSink("http://x", send=lambda r, t: sent.append(r.data) or 204).publish([{"a": 1}, {"a": 2}])
    assert len(sent) == 2
    with pytest.raises(SinkError):
        HttpSink("http://x", send=lambda r, t: 500).publish([{"a": 1}])


@pytest.mark.parametrize(
    "have, ahead, drop, create",
    [("01 15 16", 7, ["01"], None), ("15", 7, [], 6), ("15 16 17 18 19 20 21", 7, [], 0), ("08 07", 1, ["07"], None), ("01 15", 7, ["01"], 6)],
)
def test_partition_plan(spark, have, ahead, drop, create):
    names = [f"events_202403{d}" for d in have.split()]
    now = datetime(2024, 3, 15, 12)
    p = maintenance.plan([*names, "events_invalid", "events"], now, days_ahead=ahead)
    assert p.drop == [f"events_202403{d}" for d in drop] and (create is None or len(p.create) == create)
    df = spark.createDataFrame([(n,) for n in [*names, "events_invalid"]], "name string")
    assert sorted(r.name for r in maintenance.to_drop(df, now).collect()) == p.drop
    assert sorted(r.name for r in maintenance.to_create(df, now, days_ahead=ahead).collect()) == p.create


def test_maintenance_drops_days_on_storage(spark, tmp_path):
    path = str(tmp_path / "log")
    old = [e | {"id": "old", "created_at": e["created_at"] - timedelta(days=20)} for e in events(1)]
    eventlog.append(frame(spark, [*old, *events(2)]), path)
    assert [tuple(r) for r in maintenance.listed_partitions(spark, path).collect()] == [(r["name"], r["date"]) for r in maintenance.existing_partitions(eventlog.read(spark, path)).collect()]
    assert maintenance.run(spark, path, DAY).drop == ["events_20240224"] and eventlog.read(spark, path).count() == 2


def test_background_runs_one_task_at_a_time():
    b = Background()
    assert b.status == "idle" and b.try_start(lambda: 5) and not b.try_start(lambda: 6)
    assert b.wait() == 5 and b.status == "idle"
    assert "stream_failover_active" in (lambda x: (x.gauge(m.ACTIVE, 1, stream_id=1), x.exposition())[1])(m.Metrics())


def test_histograms_keep_sum_and_count_of_all_samples():
    x = m.Metrics()
    for i in range(1, 20_001):
        x.observe(m.RUN_MS, i, stream_id=1)
    text = x.exposition()
    assert f'{m.RUN_MS}_count{{stream_id="1"}} 20000' in text and f'{m.RUN_MS}_sum{{stream_id="1"}} {20_000 * 20_001 // 2}' in text
    [h] = x.samples.values()
    assert abs(h.quantile(0.5) / 10_000 - 1) < 0.06 and abs(h.quantile(0.99) / 19_800 - 1) < 0.06 and len(h.cells) < 300


def test_metrics_are_served():
    import urllib.request

    x = m.Metrics()
    x.count(m.EVENTS, 3, stream_id=1)
    server = m.serve(x, 0, "127.0.0.1")
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/metrics", timeout=10) as r:
            assert r.read().decode() == x.exposition()
    finally:
        server.shutdown()


def test_lag_takes_times_without_a_zone_as_local(tmp_path):
    from datetime import UTC

    now = datetime.now()
    d = Delivery(1, MemorySink(), ListLog([]), StateStore(tmp_path), clock=lambda: datetime.now(UTC))
    d.tick([{"id": "a", "created_at": now, "payload": "{}", "stream_id": 1}])
    assert 0 <= d.metrics.value(m.LAG, stream_id=1) < 60_000


@pytest.mark.parametrize("remote", [False, True])
def test_state_and_ledger_files(spark, tmp_path, remote):
    where = (tmp_path / "s", None) if not remote else (f"file://{tmp_path}/s", spark)
    store, ledger = StateStore(*where), PositionLedger(*where)
    state = store.load(3, DAY)
    state.checkpoint = (DAY, "é")
    store.save(state)
    assert store.load(3).checkpoint == (DAY, "é") and [s.id for s in store.rows()] == [3]
    assert ledger.confirmed("f") is None
    first = ledger.open("f", "run", 0, DAY)
    assert ledger.open("f", "run", 0, DAY + timedelta(hours=1)) == first == (DAY, 1)
    ledger.confirm("f", 1)
    ledger.confirm("f", 0)
    assert ledger.confirmed("f") == 1 and ledger.open("f", "run", 1, DAY)[1] == 2 and ledger.open("f", "new run", 1, DAY)[1] == 3


def test_capture_runs_again_without_a_trace_and_confirms_positions(spark, tmp_path, monkeypatch):
    from tidelog.operators.subscription import Registry, Subscription
    from tidelog.sources import changefeed

    source, log, cp = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, name string")
    rows.coalesce(1).write.mode("append").parquet(source)
    feed = changefeed.inserts_from(changefeed.file_stream(spark, source, rows.schema), "t")
    registry, ledger = Registry([Subscription("k", 1, "INSERT", "t", column_names=("id", "name"))]), PositionLedger(tmp_path / "ledger")
    confirm = ledger.confirm

    def crash(*a):
        raise RuntimeError("crash after the append")

    monkeypatch.setattr(ledger, "confirm", crash)
    with pytest.raises(Exception, match="crash after"):
        start_capture(feed, registry, log, cp, ledger=ledger).awaitTermination(120)
    first = sorted((r.id, r.created_at, r.lsn) for r in eventlog.read(spark, log).collect())
    assert len(first) == 3 == len({i for i, _, _ in first})  # equal rows are different events
    monkeypatch.setattr(ledger, "confirm", confirm)
    start_capture(feed, registry, log, cp, ledger=ledger).awaitTermination(120)
    assert sorted((r.id, r.created_at, r.lsn) for r in eventlog.read(spark, log).collect()) == first and ledger.confirmed("feed") == 1
    rows.limit(1).coalesce(1).write.mode("append").parquet(source)
    start_capture(feed, registry, log, cp, ledger=ledger).awaitTermination(120)
    assert sorted(int(r.lsn) for r in eventlog.read(spark, log).collect()) == [1, 1, 1, 2] and ledger.confirmed("feed") == 2


def test_history_is_skipped(spark, tmp_path):
    path, rows = str(tmp_path / "log"), events(8)
    eventlog.append(frame(spark, rows[:5]), path)
    stream = eventlog.read_stream(spark, path)
    skip_history(stream, str(tmp_path / "cp"))
    eventlog.append(frame(spark, rows[5:]), path)
    sink = MemorySink()
    d = Delivery(1, sink, TableLog(lambda: eventlog.read(spark, path), 1, 10), StateStore(tmp_path / "s"))
    start_delivery(stream, d, str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert [e["id"] for e in sink.events()] == ["e005", "e006", "e007"]


def test_a_stop_waits_for_the_running_batch():
    import threading
    import time

    gate, order = Gate(), []

    class Query:
        def stop(self):
            order.append("stopped")

    def batch():
        with gate:
            order.append("begun")
            time.sleep(0.3)
            order.append("done")

    t = threading.Thread(target=batch)
    t.start()
    time.sleep(0.1)
    gate.stop(Query())
    t.join()
    assert order == ["begun", "done", "stopped"] and gate.closed


def test_names_and_keys(spark):
    assert (keys.slot_name(3), keys.publication_name(3)) == ("tidelog_stream_3", "tidelog_publication_3")
    assert keys.partition_bounds(DAY.date()) == ("2024-03-15", "2024-03-16")
    df = frame(spark, events(3))
    low, high = keys.partition_bounds_columns(df.event_date)
    assert df.select(low, high).distinct().collect() == [("2024-03-15", "2024-03-16")]
    assert [r.id for r in df.orderBy(keys.event_key().desc()).collect()] == ["e002", "e001", "e000"]


def test_migrations_and_table_lookup(spark, tmp_path):
    try:
        with pytest.raises(LookupError):
            maintenance.table_id(spark, "tide_events")
        assert maintenance.migrate(spark, str(tmp_path / "log"), "tide_events") == [1, 2]
        assert maintenance.migrate(spark, str(tmp_path / "log"), "tide_events") == []
        assert maintenance.table_id(spark, "tide_events").endswith("default.tide_events")
        assert {f.name for f in eventlog.SCHEMA} <= set(spark.table("tide_events").columns)
    finally:
        spark.sql("DROP TABLE IF EXISTS tide_events")
