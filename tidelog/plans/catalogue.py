"""Queries over the engine's operators, each with the SQL that an independent engine can run on the same tables.

The ``events`` table plays two parts: a source table whose rows are all inserts, and the event log, with
``id = event_id``, ``created_at = ts``, ``stream_id = user_id % 3 + 1``, ``metadata = props`` and ``lsn = event_id * 16``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import epoch_ms, lsn_to_decimal, lsn_to_text, partition_bounds_columns
from ..functions.payload import Extension, to_payload
from ..operators import eventlog, maintenance
from ..operators.subscription import Subscription, apply_sync, sync_plan
from ..sources import changefeed
from .compiler import capture, matched

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = datetime(2024, 1, 15)


def query(oracle: str | None = None):
    def note(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return note


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.inserts_from(table(spark, sf_dir, "events"), "events", txn_ts=F.col("ts"), change_id=F.col("event_id"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lpad(F.col("event_id").cast("string"), 20, "0").alias("id"), F.to_json(F.struct("event_type", "value")).alias("payload"), F.col("props").alias("metadata"), (F.col("user_id") % 3 + 1).alias("stream_id"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_id") * 16).cast("decimal(20,0)").alias("lsn"))


LOG = "(select lpad(cast(event_id as varchar), 20, '0') as id, event_id, event_type, value, props as metadata, user_id % 3 + 1 as stream_id, ts as created_at, event_id * 16 as lsn from events)"


def values(rows: DataFrame, *paths: tuple[str, str, str]) -> DataFrame:
    """Typed columns out of the JSON payload."""
    cols = [F.get_json_object("payload", p).cast(t).alias(n) for n, p, t in paths]
    return rows.select("tg_name", "stream_id", *cols)


def sub(key: str, stream: int = 1, op: str = "INSERT", when: str | None = None, columns=("event_id", "event_type", "value"), ext=(), table_name: str = "events") -> Subscription:
    return Subscription(key, stream, op, table_name, when_clause=when, column_names=tuple(columns), payload_extensions=tuple(Extension(*x) for x in ext))


ID = ("event_id", "$.new.event_id", "bigint")


@query("""select 'errors' as tg_name, cast(1 as bigint) as stream_id, event_id, event_type, upper(event_type) as kind, 'web' as source, value * 2 as doubled, true as old_null
    from events where event_type = 'error'""")
def capture_insert_when(spark, sf_dir):
    s = sub("errors", when="new.event_type = 'error'", ext=[("kind", "upper(new.event_type)"), ("meta.source", "'web'"), ("doubled", "new.value * 2")])
    rows = matched(feed(spark, sf_dir), [s])
    return rows.select("tg_name", "stream_id", *[F.get_json_object("payload", p).cast(t).alias(n) for n, p, t in (ID, ("event_type", "$.new.event_type", "string"), ("kind", "$.kind", "string"), ("source", "$.meta.source", "string"), ("doubled", "$.doubled", "double"))], F.get_json_object("payload", "$.old").isNull().alias("old_null"))


@query("""select 'errors' as tg_name, cast(1 as bigint) as stream_id, event_id from events where event_type = 'error'
    union all select 'large', cast(2 as bigint), event_id from events where value > 50
    union all select 'users', cast(1 as bigint), event_id from events where user_id % 2 = 0""")
def capture_multi_sub_fanout(spark, sf_dir):
    subs = [sub("errors", when="new.event_type = 'error'"), sub("large", 2, when="new.value > 50"), sub("users", when="new.user_id % 2 = 0")]
    return values(matched(feed(spark, sf_dir), subs), ID)


@query("""select 'all' as tg_name, cast(1 as bigint) as stream_id, event_id from events
    union all select 'blank', cast(1 as bigint), event_id from events
    union all select 'errors', cast(1 as bigint), event_id from events where event_type = 'error'""")
def capture_empty_when(spark, sf_dir):
    return values(matched(feed(spark, sf_dir), [sub("all"), sub("blank", when=""), sub("errors", when="new.event_type = 'error'")]), ID)


@query("select 'nulls' as tg_name, cast(1 as bigint) as stream_id, event_id from events where nullif(event_type, 'error') <> 'click'")
def capture_null_predicate(spark, sf_dir):
    return values(matched(feed(spark, sf_dir), [sub("nulls", when="nullif(new.event_type, 'error') <> 'click'")]), ID)


def order_changes(spark, sf_dir) -> DataFrame:
    before = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 100).otherwise(F.col("o_totalprice"))
    after = before.where("o_orderkey % 10 <> 0").withColumn("o_totalprice", price)
    return changefeed.snapshot_diff(before, after, ["o_orderkey"], "orders", txn_ts=F.lit(NOW))


ORDERS = ("o_orderkey", "o_totalprice")


@query("""select 'repriced' as tg_name, o_orderkey, o_totalprice as old_price, o_totalprice + 100 as new_price from orders
    where o_orderkey % 10 <> 0 and o_orderkey % 7 = 0 and o_totalprice > 1000""")
def capture_update_diff(spark, sf_dir):
    rows = matched(order_changes(spark, sf_dir), [sub("repriced", op="UPDATE", when="old.o_totalprice > 1000", columns=ORDERS, table_name="orders")])
    return values(rows, ("o_orderkey", "$.new.o_orderkey", "bigint"), ("old_price", "$.old.o_totalprice", "double"), ("new_price", "$.new.o_totalprice", "double")).drop("stream_id")


@query("select 'deleted' as tg_name, o_orderkey, o_totalprice as old_price, true as new_null from orders where o_orderkey % 10 = 0")
def capture_delete_diff(spark, sf_dir):
    rows = matched(order_changes(spark, sf_dir), [sub("deleted", op="DELETE", columns=ORDERS, table_name="orders")])
    return rows.select("tg_name", F.get_json_object("payload", "$.old.o_orderkey").cast("bigint").alias("o_orderkey"), F.get_json_object("payload", "$.old.o_totalprice").cast("double").alias("old_price"), F.get_json_object("payload", "$.new").isNull().alias("new_null"))


@query("select event_id, 'OVERRIDDEN' as tg_op, event_type as new_value, 'events' as tg_table_name, 'public' as tg_table_schema from events where event_type = 'view'")
def capture_ext_override(spark, sf_dir):
    s = sub("o", when="new.event_type = 'view'", ext=[("tg_op", "'OVERRIDDEN'"), ("new", "new.event_type"), ("id", "new.event_id")])
    p = lambda n: F.get_json_object("payload", f"$.{n}")
    return matched(feed(spark, sf_dir), [s]).select(p("id").cast("bigint").alias("event_id"), p("tg_op").alias("tg_op"), p("new").alias("new_value"), p("tg_table_name").alias("tg_table_name"), p("tg_table_schema").alias("tg_table_schema"))


@query("select event_id, '1' as a, cast(null as varchar) as a_b, cast(null as varchar) as m_a_x, 'y' as m_a_y, 'z' as m_b from events where event_type = 'signup'")
def capture_ext_conflict(spark, sf_dir):
    s = sub("c", when="new.event_type = 'signup'", ext=[("a.b", "'lost'"), ("a", "'1'"), ("m.a.x", "'x'"), ("m.a.y", "'y'"), ("m.b", "'z'"), ("id", "new.event_id")])
    p = lambda n: F.get_json_object("payload", f"$.{n}")
    return matched(feed(spark, sf_dir), [s]).select(p("id").cast("bigint").alias("event_id"), p("a").alias("a"), p("a.b").alias("a_b"), p("m.a.x").alias("m_a_x"), p("m.a.y").alias("m_a_y"), p("m.b").alias("m_b"))


@query("select event_id, '{}' as new_image from events where event_type = 'purchase'")
def capture_empty_columns(spark, sf_dir):
    s = sub("e", when="new.event_type = 'purchase'", columns=(), ext=[("id", "new.event_id")])
    return matched(feed(spark, sf_dir), [s]).select(F.get_json_object("payload", "$.id").cast("bigint").alias("event_id"), F.get_json_object("payload", "$.new").alias("new_image"))


@query("""with x as (select 'errors' as tg_name, cast(1 as bigint) as stream_id, event_id, ts, event_type, value from events where event_type = 'error'
        union all select 'large', cast(2 as bigint), event_id, ts, event_type, value from events where value > 50),
    y as (select *, md5(cast(event_id as varchar) || '|' || tg_name || '|' || cast(stream_id as varchar)) as h, lower(lpad(format('{:x}', epoch_us(ts) // 1000), 12, '0')) as t from x)
    select substr(t, 1, 8) || '-' || substr(t, 9, 4) || '-7' || substr(h, 13, 3) || '-' || ['8', '9', 'a', 'b'][(('0x' || substr(h, 16, 1))::int % 4 + 1)::int] || substr(h, 17, 3) || '-' || substr(h, 20, 12) as id,
        tg_name, event_id, event_type, stream_id, ts as created_at, cast(null as decimal(20,0)) as lsn, cast(ts as date) as event_date from y""")
def capture_event_rows(spark, sf_dir):
    rows = capture(feed(spark, sf_dir), [sub("errors", when="new.event_type = 'error'"), sub("large", 2, when="new.value > 50")], clock=F.col("txn_ts"))
    p = lambda n: F.get_json_object("payload", f"$.{n}")
    return ntz(rows.select("id", p("tg_name").alias("tg_name"), p("new.event_id").cast("bigint").alias("event_id"), p("new.event_type").alias("event_type"), "stream_id", "created_at", "lsn", "event_date"))


@query("select event_id, cast(round(epoch_us(ts) / 1000.0) as bigint) as ms from events")
def payload_timestamp_ms(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", epoch_ms(F.col("ts")).alias("ms"))


@query("select event_id, event_type, value, cast(json_extract(props, '$.k') as bigint) as k from events")
def payload_json_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = e.select(F.parse_json(to_payload({"new": F.struct("event_id", "event_type", "value"), "old": F.lit(None).cast("string")})).alias("v"), F.parse_json("props").alias("p"))
    return v.select(F.variant_get("v", "$.new.event_id", "bigint").alias("event_id"), F.variant_get("v", "$.new.event_type", "string").alias("event_type"), F.variant_get("v", "$.new.value", "double").alias("value"), F.variant_get("p", "$.k", "bigint").alias("k"))


@query(f"select id, stream_id, created_at, lsn from (select id, stream_id, created_at, cast(lsn as decimal(20,0)) as lsn, event_type from {LOG}) where stream_id = 1 and event_type <> 'view'")
def publication_filter(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("op", F.when(F.get_json_object("payload", "$.event_type") == "view", "UPDATE").otherwise("INSERT"))
    return ntz(eventlog.publication(changefeed.insert_messages(rows), 1).select("id", "stream_id", "created_at", "lsn"))


def ntz(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def nth(spark, sf_dir, n: int):
    """The key of the log's n-th event by identifier."""
    r = log(spark, sf_dir).where(F.col("id") == str(n).zfill(20)).first()
    return (r["created_at"], r["id"])


KEYS = "(select max(case when event_id = 100 then ts end) as t0, max(case when event_id = 700 then ts end) as t1 from events)"
A, Z = "lpad('100', 20, '0')", "lpad('700', 20, '0')"
LOW, HIGH = f"case when t0 <= t1 then {A} else {Z} end", f"case when t0 <= t1 then {Z} else {A} end"


def span(spark, sf_dir):
    return sorted([nth(spark, sf_dir, 100), nth(spark, sf_dir, 700)])


@query(f"select id, created_at, metadata from {LOG} where event_id = 500")
def point_lookup(spark, sf_dir):
    key = nth(spark, sf_dir, 500)
    return ntz(eventlog.point_lookup(log(spark, sf_dir), key[1], key[0]).select("id", "created_at", "metadata"))


@query(f"""select id, created_at from {LOG}, {KEYS} where stream_id = 2
    and (created_at > least(t0, t1) or (created_at = least(t0, t1) and id > {LOW})) and (created_at < greatest(t0, t1) or (created_at = greatest(t0, t1) and id < {HIGH}))""")
def replay_range(spark, sf_dir):
    a, b = span(spark, sf_dir)
    return ntz(eventlog.replay_range(log(spark, sf_dir), 2, a, b).select("id", "created_at"))


@query(f"select id, created_at from {LOG} where 1 = 0")
def replay_empty_range(spark, sf_dir):
    a = nth(spark, sf_dir, 100)
    return ntz(eventlog.replay_range(log(spark, sf_dir), 2, a, a).select("id", "created_at"))


@query(f"select id, created_at, cast(lsn as decimal(20,0)) as lsn from {LOG} where stream_id = 2 and lsn > 8000 order by created_at, id limit 1")
def first_after_lsn(spark, sf_dir):
    return ntz(eventlog.first_after_lsn(log(spark, sf_dir), 2, 8000).select("id", "created_at", "lsn"))


@query("select event_id, cast(cast(event_id * 400000 % 4294967296 as hugeint) * 4294967296 + event_id as decimal(20,0)) as lsn, true as same from events")
def lsn_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat_ws("/", F.hex(F.col("event_id") * 400000 % (1 << 32)), F.hex("event_id")).alias("t"))
    return e.select("event_id", lsn_to_decimal(F.col("t")).alias("lsn"), (lsn_to_text(lsn_to_decimal(F.col("t"))) == F.col("t")).alias("same"))


@query(f"""select stream_id, day, chunk, count(*) as n, min(created_at) as first_at, max(created_at) as last_at, arg_min(id, (created_at, id)) as first_id, arg_max(id, (created_at, id)) as last_id from
    (select *, cast(created_at as date) as day, cast(ceil(row_number() over (partition by stream_id, cast(created_at as date) order by created_at, id) / 100.0) as bigint) as chunk from {LOG}) group by 1, 2, 3""")
def batch_chunks(spark, sf_dir):
    rows = eventlog.chunk_ids(log(spark, sf_dir), 100).withColumn("day", F.to_date("created_at"))
    out = eventlog.first_and_last(rows, "stream_id", "day", "chunk")
    return ntz(out.select("stream_id", "day", "chunk", "n", F.col("first.created_at").alias("first_at"), F.col("last.created_at").alias("last_at"), F.col("first.id").alias("first_id"), F.col("last.id").alias("last_id")))


@query(f"""select s.id, e.id as checkpoint_id, e.created_at as checkpoint_ts, e.id is null and s.cid is not null as dangling from
    (select cast(1 as bigint) as id, null::varchar as cid, null::timestamp as cts union all
     select 2, {A}, (select t0 from {KEYS}) union all select 3, 'gone', timestamp '2024-01-02 00:00:00') s
    left join {LOG} e on e.id = s.cid and e.created_at = s.cts""")
def checkpoint_join(spark, sf_dir):
    t, i = nth(spark, sf_dir, 100)
    states = spark.createDataFrame([(1, None, None), (2, i, t), (3, "gone", datetime(2024, 1, 2))], "id bigint, failover_checkpoint_id string, failover_checkpoint_ts timestamp")
    out = eventlog.resume(states, log(spark, sf_dir))
    found = F.col("checkpoint_payload").isNotNull()
    return ntz(out.select("id", F.when(found, F.col("failover_checkpoint_id")).alias("checkpoint_id"), F.when(found, F.col("failover_checkpoint_ts")).alias("checkpoint_ts"), (~found & F.col("failover_checkpoint_id").isNotNull()).alias("dangling")))


@query("""with a as (select n_nationkey as k, n_name as body from nation where n_nationkey % 5 <> 0),
    b as (select n_nationkey as k, case when n_nationkey % 4 = 0 then upper(n_name) || '!' else n_name end as body from nation where n_nationkey % 3 <> 0)
    select coalesce(a.k, b.k)::bigint as stream_id, 'k' || coalesce(a.k, b.k) as key, case when a.k is null then 'insert' when b.k is null then 'delete' when a.body is distinct from b.body then 'update' else 'noop' end as action
    from a full join b on a.k = b.k""")
def subscription_sync(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("bigint"))
    shape = lambda df, when: df.select(F.col("k").alias("stream_id"), F.concat(F.lit("k"), F.col("k").cast("string")).alias("key"), F.lit("public").alias("schema_name"), F.lit("nation").alias("table_name"), F.lit("INSERT").alias("operation"), when.alias("when_clause"), F.array(F.lit("n_name")).alias("column_names"), F.lit(None).cast("array<struct<json_path:string,expression:string>>").alias("payload_extensions"), F.lit(None).cast("string").alias("metadata"))
    a = shape(n.where("k % 5 <> 0"), F.col("n_name"))
    b = shape(n.where("k % 3 <> 0"), F.when(F.col("k") % 4 == 0, F.concat(F.upper("n_name"), F.lit("!"))).otherwise(F.col("n_name")))
    return sync_plan(a, b).select("stream_id", "key", "action")


@query("""with a as (select n_nationkey as k, n_regionkey as r, n_name as body from nation where n_nationkey % 5 <> 0),
    b as (select n_nationkey as k, n_regionkey as r, n_name || '!' as body from nation where n_nationkey % 3 <> 0)
    select r::bigint as stream_id, 'k' || k as key, body as when_clause from a where r <> 2 union all select r::bigint, 'k' || k, body from b where r = 2""")
def subscription_set(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    shape = lambda df, body: df.select(F.col("n_regionkey").cast("bigint").alias("stream_id"), F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), body.alias("when_clause"))
    return apply_sync(shape(n.where("n_nationkey % 5 <> 0"), F.col("n_name")), shape(n.where("n_nationkey % 3 <> 0"), F.concat("n_name", F.lit("!"))), 2)


@query(f"select stream_id, cast(max(lsn) as decimal(20,0)) as lsn from {LOG} where created_at < timestamp '2024-01-20' group by 1")
def position_ledger(spark, sf_dir):
    return eventlog.confirmed_positions(log(spark, sf_dir).where(F.col("created_at") < F.lit(datetime(2024, 1, 20))))


@query("select cast(n_nationkey as bigint) as table_id from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA' and n_name = 'CHINA'")
def table_lookup(spark, sf_dir):
    classes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("table_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("namespace_id"))
    spaces = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("namespace_id"), F.col("r_name").alias("name"))
    return maintenance.find_table(classes, spaces, "ASIA", "CHINA")


@query("select distinct 'events_' || strftime(ts, '%Y%m%d') as name, cast(ts as date) as date from events")
def partitions_list(spark, sf_dir):
    return maintenance.existing_partitions(log(spark, sf_dir))


@query("select distinct 'events_' || strftime(ts, '%Y%m%d') as name, cast(ts as date) as date from events where cast(ts as date) < date '2024-01-08'")
def partitions_drop(spark, sf_dir):
    return maintenance.to_drop(maintenance.existing_partitions(log(spark, sf_dir)), NOW)


@query("""select 'events_' || strftime(d, '%Y%m%d') as name, cast(d as date) as date from
    (select unnest(generate_series(timestamp '2024-01-15', timestamp '2024-01-21', interval 1 day)) as d) where cast(d as date) not in (select cast(ts as date) from events where ts < timestamp '2024-01-18')""")
def partitions_create(spark, sf_dir):
    have = maintenance.existing_partitions(log(spark, sf_dir).where(F.col("created_at") < F.lit(datetime(2024, 1, 18))))
    return maintenance.to_create(have, NOW)


@query("select distinct 'events_' || strftime(ts, '%Y%m%d') as name, strftime(ts, '%Y-%m-%d') as low, strftime(ts + interval 1 day, '%Y-%m-%d') as high from events")
def partitions_bounds(spark, sf_dir):
    days = maintenance.existing_partitions(log(spark, sf_dir))
    low, high = partition_bounds_columns(F.col("date"))
    return days.select("name", low.alias("low"), high.alias("high"))


@query(f"""select stream_id, count(*) as events_processed, arg_max(id, (created_at, id)) as last_id, max(created_at) as last_at,
    cast(floor((epoch_us(timestamp '2024-02-01') - epoch_us(max(created_at))) / 1000) as bigint) as lag_ms from {LOG} group by 1""")
def stream_metrics(spark, sf_dir):
    out = eventlog.first_and_last(log(spark, sf_dir), "stream_id")
    lag = F.floor((F.unix_micros(F.lit(datetime(2024, 2, 1)).cast("timestamp")) - F.unix_micros("last.created_at")) / 1000).cast("bigint")
    return ntz(out.select("stream_id", F.col("n").alias("events_processed"), F.col("last.id").alias("last_id"), F.col("last.created_at").alias("last_at"), lag.alias("lag_ms")))


@query(f"select id from {LOG} where not (event_id % 3 = 0 or event_type = 'click')")
def missed_events(spark, sf_dir):
    e = log(spark, sf_dir)
    done = e.where((F.col("id").cast("bigint") % 3 == 0) | (F.get_json_object("payload", "$.event_type") == "click"))
    return eventlog.missed(e, done).select("id")


@query(f"""select id from {LOG}, {KEYS} where stream_id = 1
    and (created_at > least(t0, t1) or (created_at = least(t0, t1) and id > {LOW})) and (created_at < greatest(t0, t1) or (created_at = greatest(t0, t1) and id <= {HIGH})) and event_id not in (103, 106, 109)""")
def failover_replay_window(spark, sf_dir):
    a, b = span(spark, sf_dir)
    return eventlog.failover_window(log(spark, sf_dir), 1, a, b, [str(i).zfill(20) for i in (103, 106, 109)]).select("id")


@query(f"select id, cast(case when event_id % 4 = 0 then 2 else 1 end as bigint) as deliveries from {LOG}")
def at_least_once_dedup(spark, sf_dir):
    e = log(spark, sf_dir)
    return eventlog.distinct_deliveries(e.unionByName(e.where(F.col("id").cast("bigint") % 4 == 0))).select("id", "deliveries")


@query(f"select id, created_at, cast(lsn as decimal(20,0)) as lsn, stream_id from {LOG}")
def row_conversion(spark, sf_dir):
    return ntz(eventlog.convert(log(spark, sf_dir).withColumn("extra", F.lit(1))).select("id", "created_at", "lsn", "stream_id"))


@query("select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem where l_quantity > 45 and l_returnflag = 'R' union all select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem where l_discount >= 0.09")
def capture_lineitem_fanout(spark, sf_dir):
    rows = changefeed.inserts_from(table(spark, sf_dir, "lineitem"), "lineitem", txn_ts=F.col("l_shipdate"))
    cols = ("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    subs = [sub("bulk_returns", when="new.l_quantity > 45 and new.l_returnflag = 'R'", columns=cols, table_name="lineitem"), sub("discounted", 2, when="new.l_discount >= 0.09", columns=cols, table_name="lineitem")]
    kind = "new struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>"
    return matched(rows, subs).select(F.from_json("payload", kind).alias("p")).select("p.new.*")

