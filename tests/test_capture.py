import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidelog.functions.payload import Extension
from tidelog.operators.subscription import Registry, StoredRegistry, Subscription, as_frame, sync_plan
from tidelog.plans.compiler import capture, matched, validate
from tidelog.sources import changefeed

COLUMNS = ("id", "name", "email", "age")
T = datetime(2024, 3, 1, 12, 0, 0, 1600)


def users(spark, *rows):
    return spark.createDataFrame([(i, n, f"{n.lower()}@example.com", a) for i, n, a in rows], "id int, name string, email string, age int")


def sub(key, stream=1, op="INSERT", when=None, ext=(), columns=COLUMNS):
    return Subscription(key, stream, op, "users", when_clause=when, column_names=columns, payload_extensions=tuple(Extension(*x) for x in ext))


def inserts(spark, *rows):
    return changefeed.inserts_from(users(spark, *rows), "users", txn_ts=F.lit(T))


def payloads(df):
    return [(r.tg_name, r.stream_id, json.loads(r.payload)) for r in df.collect()]


def test_insert_has_its_image_and_no_old(spark):
    [(name, stream, p)] = payloads(matched(inserts(spark, (1, "Alice", 30)), [sub("user_created")]))
    assert (name, stream, p["tg_op"], p["tg_table_name"], p["tg_table_schema"]) == ("user_created", 1, "INSERT", "users", "public")
    assert p["new"] == {"id": 1, "name": "Alice", "email": "alice@example.com", "age": 30} and "old" in p and p["old"] is None
    assert p["timestamp"] == 1709294400002  # 1.6 ms round up


def test_when_clause_and_null_result(spark):
    got = payloads(matched(inserts(spark, (1, "Bob", 25), (2, "Charlie", 15), (3, "Null", None)), [sub("adult", when="new.age >= 18")]))
    assert [p["new"]["name"] for _, _, p in got] == ["Bob"]


def test_update_and_delete_images(spark):
    before, after = users(spark, (1, "Diana", 28), (2, "Eve", 35), (3, "Same", 1)), users(spark, (1, "Diana", 29), (3, "Same", 1))
    feed = changefeed.snapshot_diff(before, after, ["id"], "users", txn_ts=F.lit(T))
    got = {n: p for n, _, p in payloads(matched(feed, [sub("updated", op="UPDATE"), sub("deleted", op="DELETE")]))}
    assert (got["updated"]["old"]["age"], got["updated"]["new"]["age"]) == (28, 29)
    assert got["deleted"]["new"] is None and got["deleted"]["old"]["name"] == "Eve" and len(got) == 2


def test_extensions(spark):
    ext = [("metadata.source", "'web_app'"), ("metadata.version", "'1.0.0'"), ("custom_field", "'custom_value'"), ("user_name_upper", "upper(new.name)"), ("is_senior", "new.age >= 30"), ("age_doubled", "new.age * 2")]
    [(_, _, p)] = payloads(matched(inserts(spark, (1, "Frank", 40)), [sub("x", ext=ext)]))
    assert p["metadata"] == {"source": "web_app", "version": "1.0.0"} and p["custom_field"] == "custom_value"
    assert (p["user_name_upper"], p["is_senior"], p["age_doubled"]) == ("FRANK", True, 80)


def test_conflicting_extension_paths(spark):
    ext = [("a.b", "1"), ("a", "2"), ("m.a.x", "3"), ("m.a.y", "4"), ("tg_op", "'mine'"), ("new", "5")]
    [(_, _, p)] = payloads(matched(inserts(spark, (1, "F", 4)), [sub("x", ext=ext)]))
    assert p["a"] == 2 and p["m"] == {"a": {"y": 4}} and p["tg_op"] == "mine" and p["new"] == 5


def test_two_subscriptions_and_two_streams(spark):
    subs = [sub("young_user", 6, when="new.age < 30"), sub("old_user", 7, when="new.age >= 30")]
    got = payloads(matched(inserts(spark, (1, "Grace", 25), (2, "Henry", 35)), subs))
    assert {(n, s, p["new"]["name"]) for n, s, p in got} == {("young_user", 6, "Grace"), ("old_user", 7, "Henry")}


def test_empty_columns_and_quoted_names(spark):
    df = spark.createDataFrame([(1, "x")], "`odd name` int, `tick``` string")
    feed = changefeed.inserts_from(df, "users", txn_ts=F.lit(T))
    got = {n: p["new"] for n, _, p in payloads(matched(feed, [sub("a", columns=()), sub("b", columns=("odd name", "tick`"))]))}
    assert got == {"a": {}, "b": {"odd name": 1, "tick`": "x"}}


def test_registry_and_removal(spark):
    r = Registry([sub("temp"), sub("stay")])
    was = r.fingerprint
    assert r.remove("temp") == 1 and r.fingerprint != was
    assert [n for n, _, _ in payloads(matched(inserts(spark, (1, "Ivy", 22)), r.all()))] == ["stay"]
    r.remove("stay")
    assert matched(inserts(spark, (1, "Ivy", 22)), r.all()).count() == 0
    with pytest.raises(ValueError):
        r.set([sub("a"), sub("a")])


def test_event_rows_are_repeatable_and_ordered(spark):
    feed = inserts(spark, *[(i, f"User{i}", 20 + i) for i in range(5)]).withColumn("lsn", F.col("new.id"))
    a, b = ([r.asDict() for r in capture(feed, [sub("k")], clock=F.lit(T)).orderBy("id").collect()] for _ in range(2))
    assert a == b and len({r["id"] for r in a}) == 5 and all(r["id"][14] == "7" and r["id"][19] in "89ab" and len(r["id"]) == 36 for r in a)
    assert all(r["lsn"] is not None for r in a)


def test_validation(spark):
    with pytest.raises(Exception):
        validate(inserts(spark, (1, "A", 1)), [sub("bad", when="new.nothing = 1")])
    for bad in (dict(operation="MERGE"), dict(stream_id=None), dict(key="")):
        with pytest.raises(ValueError):
            Subscription(**(dict(key="k", stream_id=1, operation="INSERT", table_name="t") | bad))


def test_sync_plan(spark):
    now = [sub("same"), sub("changed"), sub("gone")]
    want = [sub("same"), sub("changed", when="true"), sub("fresh")]
    got = {r.key: r.action for r in sync_plan(as_frame(spark, now), as_frame(spark, want)).collect()}
    assert got == {"same": "noop", "changed": "update", "gone": "delete", "fresh": "insert"}


def test_stored_subscriptions(spark, tmp_path):
    path = str(tmp_path / "subs")
    r = StoredRegistry(spark, path)
    assert r.all() == [] and r.set_subscriptions(1, [sub("a", ext=[("x.y", "1")]), sub("b")]) == {"insert": 2}
    other = StoredRegistry(spark, path)
    assert other.all() == r.all() and other.fingerprint == r.fingerprint and r.all()[0].payload_extensions == (Extension("x.y", "1"),)
    assert r.set_subscriptions(2, [sub("c", stream=2)]) == {"insert": 1}
    assert r.set_subscriptions(1, [sub("b", when="new.age > 1"), sub("d")]) == {"insert": 1, "update": 1, "delete": 1}
    assert r.set_subscriptions(1, [sub("b", when="new.age > 1"), sub("d")]) == {"noop": 2}
    assert other.refresh() and not other.refresh() and [s.key for s in other.all()] == ["b", "d", "c"]
    with pytest.raises(ValueError):
        r.set_subscriptions(1, [sub("c", stream=2)])


def test_equal_rows_are_different_changes_and_times_keep_their_microseconds(spark):
    df = users(spark, (1, "A", 1), (1, "A", 1)).withColumn("at", F.lit("2024-01-02 03:04:05.123456").cast("timestamp_ntz"))
    feed = changefeed.inserts_from(df, "users", txn_ts=F.lit(T))
    rows = capture(feed, [sub("k", columns=("id", "at"))], clock=F.lit(T)).collect()
    assert len({r.id for r in rows}) == 2 and all(json.loads(r.payload)["new"]["at"] == "2024-01-02T03:04:05.123456" for r in rows)


def test_settings_in_clauses(spark):
    spark.conf.set("tide.kind", "it's \\ A")
    try:
        df = users(spark, (1, "it's \\ A", 1), (2, "B", 1))
        feed = changefeed.inserts_from(df, "users", txn_ts=F.lit(T))
        got = payloads(matched(feed, [sub("k", when="new.name = current_setting('tide.kind')", ext=[("by", "current_setting('tide.kind')"), ("none", "current_setting('tide.none', true)")])]))
        assert [(p["new"]["id"], p["by"], p["none"]) for _, _, p in got] == [(1, "it's \\ A", None)]
        with pytest.raises(LookupError):
            matched(feed, [sub("k", when="current_setting('tide.none') = 'x'")])
    finally:
        spark.conf.unset("tide.kind")
