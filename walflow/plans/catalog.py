"""Driver queries for the change-data-capture operators, with the same in DuckDB's SQL."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from walflow.functions import crypto, exprs
from walflow.functions.session import shuffles_dropped
from walflow.operators import delivery, events as ev, ingest
from walflow.operators.consumer import ConsumerGroup
from walflow.operators.control import ControlStore
from walflow.operators.cycle import Deliveries
from walflow.operators.followers import PositionIndex, RunningStatistics
from walflow.operators.publish import EventLog
from walflow.operators.registry import Registry
from walflow.operators.replay import Replays
from walflow.sources import binlog, scenarios, wal
from walflow.sources.commerce import activity_changes, changes, order_changes, order_messages, table
from walflow.streaming.assembly import run_capture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The change log in SQL. key_text is the normalised key; size the estimated bytes.
_EV = """WITH item AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS place FROM lineitem),
ev AS (
  SELECT 'orders' AS source_id, 2 * (o_orderkey + 1) AS xid, 1024 * (o_orderkey + 1) AS commit_end_lsn, o_orderdate AS commit_timestamp, CAST(1 AS INTEGER) AS sequence_number, 'public' AS schema_name, 'orders' AS table_name,
    'insert' AS operation, 'o_orderkey=' || o_orderkey || ';' AS key_text, CAST(200 + 51 + length(CAST(o_orderkey AS VARCHAR)) + length(CAST(o_custkey AS VARCHAR)) AS BIGINT) AS size, o_orderkey AS k, o_custkey AS cust FROM orders
  UNION ALL SELECT 'orders', 2 * (o_orderkey + 1) + 1, 1024 * (o_orderkey + 1) + 512, o_orderdate, 1, 'public', 'orders', CASE o_orderstatus WHEN 'F' THEN 'update' ELSE 'delete' END, 'o_orderkey=' || o_orderkey || ';',
    CAST(200 + 51 + length(CAST(o_orderkey AS VARCHAR)) + length(CAST(o_custkey AS VARCHAR)) AS BIGINT), o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P')
  UNION ALL SELECT 'orders', 2 * (o_orderkey + 1), 1024 * (o_orderkey + 1), o_orderdate, CAST(1 + place AS INTEGER), 'public', 'lineitem', 'insert', 'l_linenumber=' || l_linenumber || ';l_orderkey=' || l_orderkey || ';',
    CAST(200 + 48 + length(CAST(l_orderkey AS VARCHAR)) + length(CAST(l_partkey AS VARCHAR)) + length(CAST(l_linenumber AS VARCHAR)) AS BIGINT), l_orderkey, l_partkey FROM item JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'activity', event_id + 1, 16 * (event_id + 1), ts, 1, 'public', 'events', 'insert', 'user_id=' || user_id || ';', CAST(200 + 50 + length(CAST(event_id AS VARCHAR)) + length(CAST(user_id AS VARCHAR)) + length(event_type) AS BIGINT), event_id, user_id FROM events),
h AS (SELECT key_text, list_reduce(list_concat([CAST(2166136261 AS BIGINT)], list_transform(range(1, length(key_text) + 1), lambda i: CAST(ascii(key_text[i]) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) & 4294967295) AS key_hash FROM (SELECT DISTINCT key_text FROM ev)),
ek AS (SELECT ev.*, key_hash FROM ev JOIN h USING (key_text)),
sinks AS (SELECT * FROM (VALUES ('all', NULL, NULL, NULL, NULL, true), ('orders-changes', 'orders', '', 'orders', ' update, delete', true), ('activity', 'activity', 'public', NULL, 'insert', true), ('updates', NULL, NULL, '', 'update', true), ('off', NULL, NULL, NULL, NULL, false)) t(sink_id, source_filter, schema_filter, table_filter, operation_filter, enabled)),
fan AS (SELECT * FROM ev JOIN sinks ON enabled AND coalesce(source_filter, '') IN ('', source_id) AND coalesce(schema_filter, '') IN ('', schema_name) AND coalesce(table_filter, '') IN ('', table_name) AND (coalesce(operation_filter, '') = '' OR list_contains(list_transform(string_split(operation_filter, ','), lambda x: trim(x)), operation))),
att AS (SELECT event_id + 1 AS attempt_id, CASE event_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'activity' ELSE 'updates' END AS sink_id, event_id AS k, CAST(1 + event_id % 5 AS INTEGER) AS attempt_number, CAST(5 AS INTEGER) AS max_attempts,
  CAST(CASE event_id % 7 WHEN 0 THEN 200 WHEN 1 THEN 500 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 503 WHEN 5 THEN 408 ELSE NULL END AS INTEGER) AS http_status, CASE event_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'retryable' WHEN 2 THEN 'pending' ELSE 'permanent_failure' END AS status, ts AS next_retry_at FROM events)
"""
_AS_OF = "2024-01-30 12:00:00"
_PARTS = 8
SINKS = [("all", None, None, None, None, True), ("orders-changes", "orders", "", "orders", " update, delete", True), ("activity", "activity", "public", None, "insert", True), ("updates", None, None, "", "update", True), ("off", None, None, None, None, False)]
_FMT = "printf('%X/%X', commit_end_lsn >> 32, commit_end_lsn & 4294967295)"


def query(name: str, sql: str | None = None, plain: bool = False):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql if plain else _EV + sql
        return f

    return keep


def sinks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SINKS, "sink_id string, source_filter string, schema_filter string, table_filter string, operation_filter string, enabled boolean")


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("key_text", exprs.normalized_key("key_columns")).withColumn("key_hash", exprs.fnv1a32("key_text"))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Attempts made up from the events table."""
    i = F.col("event_id")
    choose = lambda n, values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % n + 1).cast("int"))
    return table(spark, d, "events").select(
        (i + 1).alias("attempt_id"), choose(3, ["all", "activity", "updates"]).alias("sink_id"), i.alias("k"), (1 + i % 5).cast("int").alias("attempt_number"), F.lit(5).alias("max_attempts"),
        choose(7, [200, 500, 404, 429, 503, 408, None]).cast("int").alias("http_status"), choose(4, ["success", "retryable", "pending", "permanent_failure"]).alias("status"), F.col("ts").alias("next_retry_at"))


PLAIN = ["source_id", "xid", "commit_end_lsn", "commit_timestamp", "sequence_number", "schema_name", "table_name", "operation", "key_text"]
_PLAIN = ", ".join(PLAIN)


@query("cdc_events_all", f"SELECT {_PLAIN} FROM ev")
def _(spark, d):
    return changes(spark, d).withColumn("key_text", exprs.normalized_key("key_columns")).select(*PLAIN)


@query("events_list_filtered", f"SELECT source_id, {_FMT} AS lsn_text, sequence_number, table_name, operation, key_text FROM ev WHERE table_name = 'orders' AND operation = 'update' ORDER BY commit_end_lsn DESC, sequence_number DESC LIMIT 100")
def _(spark, d):
    rows = ev.newest(changes(spark, d), 100, table_name="orders", operation="update")
    return rows.select("source_id", exprs.format_lsn("commit_end_lsn").alias("lsn_text"), "sequence_number", "table_name", "operation", exprs.normalized_key("key_columns").alias("key_text"))


@query("event_get", "SELECT source_id, commit_end_lsn, sequence_number, operation FROM ev WHERE upper(substr(sha256(source_id || '|' || commit_end_lsn || '|' || sequence_number), 1, 32)) = upper(substr(sha256('orders|10240|1'), 1, 32))")
def _(spark, d):
    import hashlib

    return ev.by_id(changes(spark, d).withColumn("id", exprs.event_id()), hashlib.sha256(b"orders|10240|1").hexdigest()[:32]).select("source_id", "commit_end_lsn", "sequence_number", "operation")


@query("transaction_explorer", "SELECT xid, commit_end_lsn, sequence_number, table_name, operation, key_text FROM ev WHERE source_id = 'orders' AND xid = 22 ORDER BY sequence_number")
def _(spark, d):
    return ev.transaction_events(changes(spark, d), "orders", 22).select("xid", "commit_end_lsn", "sequence_number", "table_name", "operation", exprs.normalized_key("key_columns").alias("key_text"))


@query("transaction_counts", "SELECT source_id, xid, commit_end_lsn, commit_timestamp, count(*) AS event_count, CAST(sum(size) AS BIGINT) AS total_bytes FROM ev GROUP BY ALL")
def _(spark, d):
    return ev.transactions(changes(spark, d))


@query("tx_sequence", "SELECT source_id, commit_end_lsn, min(sequence_number) AS low, max(sequence_number) AS high, count(*) AS n, min(sequence_number) = 1 AND max(sequence_number) = count(*) AS gapless FROM ev GROUP BY ALL")
def _(spark, d):
    return ev.sequences(changes(spark, d))


def _messages(spark, d):
    """The order log taken apart again into WAL messages: begin, changes, commit, with every seventh transaction left open and every eleventh aborted."""
    e = order_changes(spark, d).withColumn("t", F.floor(F.col("commit_end_lsn") / 512))
    body = e.select("source_id", (F.col("commit_end_lsn") * 64 + F.col("sequence_number")).alias("pos"), F.col("operation").alias("kind"), "xid", F.lit(None).cast("long").alias("commit_end_lsn"), F.lit(None).cast("timestamp_ntz").alias("commit_timestamp"), "schema_name", "table_name", "before", "after", "key_columns")
    tx = e.filter("sequence_number = 1")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("schema_name", "string"), ("table_name", "string"))] + [F.lit(None).cast(body.schema[c].dataType).alias(c) for c in ("before", "after", "key_columns")]
    begin = tx.select("source_id", (F.col("commit_end_lsn") * 64).alias("pos"), F.lit("begin").alias("kind"), "xid", F.lit(None).cast("long").alias("commit_end_lsn"), F.lit(None).cast("timestamp_ntz").alias("commit_timestamp"), *none)
    end = tx.filter("xid % 7 <> 0").select("source_id", (F.col("commit_end_lsn") * 64 + 63).alias("pos"), F.when(F.col("xid") % 11 == 0, "abort").otherwise("commit").alias("kind"), "xid", "commit_end_lsn", "commit_timestamp", *none)
    return begin.unionByName(body).unionByName(end)


@query("batch_assembly", f"SELECT {_PLAIN} FROM ev WHERE source_id = 'orders' AND xid % 7 <> 0 AND xid % 11 <> 0")
def _(spark, d):
    return ingest.assembled(_messages(spark, d)).withColumn("key_text", exprs.normalized_key("key_columns")).select(*PLAIN)


@query("lsn_text_roundtrip", f"SELECT commit_end_lsn, {_FMT} AS lsn_text, commit_end_lsn AS back FROM ev WHERE source_id = 'activity'")
def _(spark, d):
    return activity_changes(spark, d).select("commit_end_lsn", exprs.format_lsn("commit_end_lsn").alias("lsn_text")).withColumn("back", exprs.parse_lsn("lsn_text"))


@query("partition_histogram", f"SELECT source_id, CAST(key_hash % {_PARTS} AS INTEGER) AS partition, count(*) AS n FROM ek GROUP BY ALL")
def _(spark, d):
    return keyed(changes(spark, d)).groupBy("source_id", exprs.partition_of("key_hash", _PARTS).alias("partition")).agg(F.count(F.lit(1)).alias("n"))


@query("normalized_key", "SELECT source_id, commit_end_lsn, sequence_number, key_text, key_hash FROM ek")
def _(spark, d):
    return keyed(changes(spark, d)).select("source_id", "commit_end_lsn", "sequence_number", "key_text", "key_hash")


@query("partition_assignment", f"SELECT CAST(key_hash % {_PARTS} AS INTEGER) AS partition, (['a', 'b', 'c'])[key_hash % {_PARTS} % 3 + 1] AS member, count(*) AS events FROM ek GROUP BY ALL")
def _(spark, d):
    """How many of the log's events each member of a group of three gets, by partition."""
    placed = keyed(changes(spark, d)).groupBy(exprs.partition_of("key_hash", _PARTS).alias("partition")).agg(F.count(F.lit(1)).alias("events"))
    return placed.withColumn("member", exprs.assigned_member("partition", F.array(F.lit("c"), F.lit("a"), F.lit("b"))))


@query("poll_page", f"SELECT commit_end_lsn, sequence_number, table_name, operation, key_text FROM ek WHERE source_id = 'orders' AND key_hash % {_PARTS} = 3 ORDER BY commit_end_lsn, sequence_number LIMIT 100")
def _(spark, d):
    return ev.poll(keyed(changes(spark, d)), "orders", _PARTS, 3, None, None, 100).select("commit_end_lsn", "sequence_number", "table_name", "operation", "key_text")


@query("poll_after_offset", f"SELECT commit_end_lsn, sequence_number, table_name, operation, key_text FROM ek WHERE source_id = 'orders' AND key_hash % {_PARTS} = 5 AND (commit_end_lsn, sequence_number) > (102400, 2) ORDER BY commit_end_lsn, sequence_number LIMIT 100")
def _(spark, d):
    return ev.poll(keyed(changes(spark, d)), "orders", _PARTS, 5, 102400, 2, 100).select("commit_end_lsn", "sequence_number", "table_name", "operation", "key_text")


@query("ingest_dedup", "SELECT source_id, commit_end_lsn, sequence_number FROM ev WHERE NOT (source_id = 'orders' AND commit_end_lsn % 2048 = 0)")
def _(spark, d):
    all_events = changes(spark, d)
    have = all_events.filter("source_id = 'orders' and commit_end_lsn % 2048 = 0")
    return ingest.fresh(all_events.unionByName(all_events.filter("xid % 3 = 0")), have).select("source_id", "commit_end_lsn", "sequence_number")


@query("hash_mismatch_count", "SELECT count(*) AS mismatches FROM ev WHERE commit_end_lsn % 3072 = 0 AND operation = 'insert'")
def _(spark, d):
    store = changes(spark, d).withColumn("payload_hash", exprs.payload_hash())
    batch = store.withColumn("payload_hash", F.when((F.col("commit_end_lsn") % 3072 == 0) & (F.col("operation") == "insert"), "0").otherwise(F.col("payload_hash")))
    return ingest.mismatches(batch, store).agg(F.count(F.lit(1)).alias("mismatches"))


@query("payload_hash_stable", "SELECT CAST(0 AS BIGINT) AS unstable", plain=True)
def _(spark, d):
    once = changes(spark, d).withColumn("payload_hash", exprs.payload_hash())
    again = changes(spark, d).withColumn("after", F.map_from_entries(F.reverse(F.map_entries("after")))).withColumn("payload_hash", exprs.payload_hash())
    return ingest.mismatches(again, once).agg(F.count(F.lit(1)).alias("unstable"))


_RELATION = """substring(sha256('public' || '{}' || {}), 1, 32)"""
_ORDER_COLUMNS = "'o_orderkey:20:false:1;o_custkey:20:true:2;o_orderstatus:1043:true:3;o_totalprice:701:true:4;o_orderdate:1114:true:5;{}:1043:true:6;'"
_ITEM_COLUMNS = "'l_orderkey:20:false:1;l_partkey:20:true:2;l_suppkey:20:true:3;l_linenumber:23:false:4;l_quantity:701:true:5;l_extendedprice:701:true:6;l_discount:701:true:7;l_tax:701:true:8;l_returnflag:1043:true:9;l_linestatus:1043:true:10;l_shipdate:1114:true:11;'"


@query("relation_asof", f"""SELECT xid, sequence_number, table_name AS relation, CASE WHEN table_name = 'lineitem' THEN {_RELATION.format("lineitem", _ITEM_COLUMNS)}
    WHEN xid >= 2 * ((SELECT max(o_orderkey) FROM orders) // 2 + 1) THEN {_RELATION.format("orders", _ORDER_COLUMNS.format("o_priority"))} ELSE {_RELATION.format("orders", _ORDER_COLUMNS.format("o_orderpriority"))} END AS relation_fingerprint
    FROM ev WHERE source_id = 'orders'""")
def _(spark, d):
    log = order_messages(spark, d)
    relations = log.filter("kind = 'relation'").select("source_id", "oid", "pos", exprs.relation_fingerprint("schema_name", "table_name", "columns").alias("fingerprint"))
    rows = log.filter("kind in ('insert', 'update', 'delete')")
    return ev.as_of_relation(rows, relations).select("xid", (F.col("pos") - 64 * F.col("xid")).cast("int").alias("sequence_number"), F.when(F.col("oid") == 1, "orders").otherwise("lineitem").alias("relation"), "relation_fingerprint")


@query("relation_fingerprint", "SELECT n_nationkey, substr(sha256('public' || n_name || 'id:20:false:1;' || 'note:25:true:2;'), 1, 32) AS fingerprint FROM nation", plain=True)
def _(spark, d):
    column = lambda n, o, null, p: F.struct(F.lit(n).alias("name"), F.lit(o).alias("type_oid"), F.lit(null).alias("nullable"), F.lit(p).alias("position"))
    return table(spark, d, "nation").select("n_nationkey", exprs.relation_fingerprint(F.lit("public"), "n_name", F.array(column("id", 20, False, 1), column("note", 25, True, 2))).alias("fingerprint"))


@query("json_by_type", "SELECT o_orderkey, '\"' || o_orderpriority || '\"' AS as_text, CAST(o_orderkey AS VARCHAR) AS as_number, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS as_bool, '\"NaN\"' AS as_nan FROM orders", plain=True)
def _(spark, d):
    v = lambda t, o: exprs.json_value(t, F.lit(o))
    return table(spark, d, "orders").select("o_orderkey", v(F.col("o_orderpriority"), 25).alias("as_text"), v(F.col("o_orderkey").cast("string"), 20).alias("as_number"), v(F.when(F.col("o_orderkey") % 2 == 0, "t").otherwise("f"), 16).alias("as_bool"), v(F.lit("NaN"), 701).alias("as_nan"))


@query("sink_fanout", "SELECT sink_id, table_name, operation, count(*) AS n FROM fan GROUP BY ALL")
def _(spark, d):
    return delivery.fan_out(changes(spark, d), sinks(spark)).groupBy("sink_id", "table_name", "operation").agg(F.count(F.lit(1)).alias("n"))


@query("sink_pending", "SELECT sink_id, source_id, count(*) AS n FROM fan WHERE NOT (sink_id = 'all' AND commit_end_lsn % 2048 = 0) GROUP BY ALL")
def _(spark, d):
    events = changes(spark, d).withColumn("id", exprs.event_id())
    tried = events.filter("commit_end_lsn % 2048 = 0").select(F.lit("all").alias("sink_id"), F.col("id").alias("event_id"))
    left = delivery.pending(events, sinks(spark), tried)
    return left.join(events.select(F.col("id").alias("event_id"), "source_id"), "event_id").groupBy("sink_id", "source_id").agg(F.count(F.lit(1)).alias("n"))


@query("due_attempts", f"SELECT attempt_id, sink_id, attempt_number FROM att WHERE status = 'pending' AND next_retry_at <= TIMESTAMP '{_AS_OF}' ORDER BY attempt_id LIMIT 10")
def _(spark, d):
    return delivery.due(attempts(spark, d), _AS_OF).select("attempt_id", "sink_id", "attempt_number")


@query("retry_outcome", "SELECT attempt_id, CASE WHEN http_status BETWEEN 200 AND 299 THEN 'success' WHEN (http_status IN (408, 425, 429) OR http_status BETWEEN 500 AND 599) AND attempt_number < max_attempts THEN 'retryable' ELSE 'permanent_failure' END AS outcome FROM att")
def _(spark, d):
    return attempts(spark, d).select("attempt_id", exprs.outcome("http_status", "attempt_number", "max_attempts").alias("outcome"))


@query("backoff_schedule", "SELECT event_id, attempt, CAST(least(1000 * pow(2, least(attempt, 40) - 1), 300000) AS BIGINT) AS delay_ms FROM (SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS attempt FROM events)", plain=True)
def _(spark, d):
    """Each user's events as the attempts of one delivery."""
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("event_id", attempt.alias("attempt")).withColumn("delay_ms", exprs.backoff_ms("attempt", F.lit(1000), F.lit(300_000)))


@query("dlq_list", "SELECT attempt_id, sink_id, attempt_number FROM att WHERE status = 'permanent_failure' ORDER BY next_retry_at DESC, attempt_id DESC LIMIT 100")
def _(spark, d):
    return delivery.dead_letter_list(attempts(spark, d)).select("attempt_id", "sink_id", "attempt_number")


@query("dlq_depth", "SELECT count(*) AS depth FROM att WHERE status = 'permanent_failure'")
def _(spark, d):
    return delivery.status_counts(attempts(spark, d)).agg(F.sum("dead").alias("depth"))


@query("stats_overview", f"SELECT count(*) AS events, count(*) FILTER (WHERE commit_timestamp > TIMESTAMP '{_AS_OF}' - INTERVAL 1 MINUTE AND commit_timestamp <= TIMESTAMP '{_AS_OF}') / 60.0 AS events_per_second, CAST(CAST(epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(max(commit_timestamp)) AS DOUBLE) / 1e6 AS DOUBLE) AS lag_seconds FROM ev")
def _(spark, d):
    return ev.statistics(changes(spark, d), _AS_OF).select("events", "events_per_second", "lag_seconds")


@query("lag_bytes", "SELECT source_id, max(commit_end_lsn) AS received, max(commit_end_lsn) FILTER (WHERE xid % 7 <> 0) AS persisted, max(commit_end_lsn) - max(commit_end_lsn) FILTER (WHERE xid % 7 <> 0) AS lag_bytes FROM ev GROUP BY source_id")
def _(spark, d):
    return ev.source_positions(changes(spark, d), F.col("xid") % 7 != 0)


@query("attempt_status_pivot", "SELECT sink_id, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS good, count(*) FILTER (WHERE status = 'retryable') AS again FROM att GROUP BY sink_id")
def _(spark, d):
    return delivery.status_counts(attempts(spark, d)).select("sink_id", "total", "good", "again")


@query("consumer_lag", f"SELECT p AS partition, count(*) FILTER (WHERE NOT (p <= 3 AND (commit_end_lsn, sequence_number) <= (512000, 2))) AS behind FROM (SELECT *, CAST(key_hash % {_PARTS} AS INTEGER) AS p FROM ek WHERE source_id = 'orders') GROUP BY p")
def _(spark, d):
    offsets = spark.createDataFrame([(p, 512000, 2) for p in range(4)], "partition int, commit_end_lsn long, sequence_number int")
    return ev.partition_lag(keyed(changes(spark, d)), offsets, "orders", _PARTS).select("partition", "behind")


@query("replay_by_lsn", "SELECT source_id, commit_end_lsn, sequence_number, operation FROM ev WHERE source_id = 'orders' AND commit_end_lsn BETWEEN 102400 AND 1024000 AND operation IN ('update', 'delete')")
def _(spark, d):
    return ev.replay_range(changes(spark, d), {"lsn": 102400}, {"lsn": 1024000}, operation_filter="update, delete", source_id="orders").select("source_id", "commit_end_lsn", "sequence_number", "operation")


@query("replay_by_time", "SELECT source_id, commit_end_lsn, sequence_number FROM ev WHERE commit_timestamp BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' AND table_name = 'events'")
def _(spark, d):
    return ev.replay_range(changes(spark, d), {"timestamp": "2024-01-10 00:00:00"}, {"timestamp": "2024-01-12 00:00:00"}, table_filter="events").select("source_id", "commit_end_lsn", "sequence_number")


@query("replay_by_event", "SELECT source_id, commit_end_lsn, sequence_number FROM ev WHERE source_id = 'orders' AND commit_end_lsn * 64 + sequence_number BETWEEN 10240 * 64 + 1 AND 102400 * 64 + 1")
def _(spark, d):
    import hashlib

    at = lambda n: {"event_id": hashlib.sha256(f"orders|{n}|1".encode()).hexdigest()[:32]}
    return ev.replay_range(changes(spark, d).withColumn("id", exprs.event_id()), at(10240), at(102400)).select("source_id", "commit_end_lsn", "sequence_number")


@query("offset_advance", f"SELECT CAST(key_hash % {_PARTS} AS INTEGER) AS partition, max(commit_end_lsn) AS commit_end_lsn, CAST(arg_max(sequence_number, commit_end_lsn * 64 + sequence_number) AS INTEGER) AS sequence_number FROM ek WHERE source_id = 'orders' GROUP BY 1")
def _(spark, d):
    return ev.end_offsets(keyed(order_changes(spark, d)), _PARTS)


@query("lease_takeover", "SELECT user_id, ts AS claimed_at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS generation FROM events", plain=True)
def _(spark, d):
    return table(spark, d, "events").select("user_id", F.col("ts").alias("claimed_at"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("generation"))


@query("event_spacing", "SELECT user_id, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap_us FROM events", plain=True)
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, d, "events").select("user_id", "event_id", (us(F.col("ts")) - us(F.lag("ts").over(w))).alias("gap_us"))


@query("state_latest_row", "SELECT source_id, table_name, key_text, commit_end_lsn FROM (SELECT *, row_number() OVER (PARTITION BY source_id, table_name, key_text ORDER BY commit_end_lsn DESC, sequence_number DESC) AS r FROM ev WHERE source_id = 'orders') WHERE r = 1 AND operation <> 'delete'")
def _(spark, d):
    return ev.latest_rows(order_changes(spark, d)).select("source_id", "table_name", _key_text().alias("key_text"), "commit_end_lsn")


@query("snapshot_asof", "SELECT source_id, table_name, key_text, commit_end_lsn FROM (SELECT *, row_number() OVER (PARTITION BY source_id, table_name, key_text ORDER BY commit_end_lsn DESC, sequence_number DESC) AS r FROM ev WHERE source_id = 'orders' AND commit_end_lsn <= 1024000) WHERE r = 1 AND operation <> 'delete'")
def _(spark, d):
    return ev.latest_rows(order_changes(spark, d), 1024000).select("source_id", "table_name", _key_text().alias("key_text"), "commit_end_lsn")


def _key_text():
    return exprs.normalized_key(F.from_json("row_key", "map<string,string>"))


@query("change_rate_window", "SELECT table_name, operation, date_trunc('hour', commit_timestamp) AS window_start, count(*) AS changes FROM ev WHERE source_id = 'activity' GROUP BY ALL")
def _(spark, d):
    return ev.change_rates(activity_changes(spark, d), "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("attempt_join", "SELECT attempt_id, sink_id, operation, key_text FROM att JOIN sinks USING (sink_id) JOIN ev ON source_id = 'activity' AND att.k = ev.k WHERE att.status = 'pending'")
def _(spark, d):
    e = activity_changes(spark, d).withColumn("k", (F.col("commit_end_lsn") / 16 - 1).cast("long"))
    return attempts(spark, d).filter("status = 'pending'").join(sinks(spark), "sink_id").join(e, "k").select("attempt_id", "sink_id", F.col("operation"), exprs.normalized_key("key_columns").alias("key_text"))


#: HMAC by its definition: the key padded to 64 bytes and combined with two fixed bytes, around two rounds of SHA-256.
_PAD = {k: "unhex('" + bytes(x ^ k for x in b"secret".ljust(64, b"\0")).hex() + "')" for k in (0x36, 0x5C)}


@query("signed_payloads", f"SELECT commit_end_lsn, 'sha256=' || sha256({_PAD[0x5C]} || unhex(sha256({_PAD[0x36]} || encode('1700000000.') || unhex(substr(sha256(source_id || '|' || commit_end_lsn || '|' || sequence_number), 1, 32)) || encode(key_text)))) AS signature FROM ev WHERE source_id = 'activity'")
def _(spark, d):
    rows = activity_changes(spark, d).withColumn("id", exprs.event_id()).withColumn("payload", exprs.normalized_key("key_columns"))
    return rows.select("commit_end_lsn", crypto.signature(F.lit(b"secret"), F.lit(1700000000), F.col("id"), F.col("payload")).alias("signature"))


@query("aes_roundtrip", "SELECT c_custkey, true AS opens, true AS wrong_context_is_null FROM customer", plain=True)
def _(spark, d):
    key, data = F.lit(b"0123456789abcdef0123456789abcdef"), F.unhex(F.sha2("c_name", 256))
    box = crypto.enveloped(F.encode("c_name", "UTF-8"), data, key, F.lit("k1"), F.lit("customer"))
    keys = {"k0": b"f" * 32, "k1": b"0123456789abcdef0123456789abcdef"}
    return table(spark, d, "customer").withColumn("box", box).select("c_custkey", (F.decode(crypto.unwrapped(F.col("box"), keys, F.lit("customer")), "UTF-8") == F.col("c_name")).alias("opens"), crypto.unwrapped(F.col("box"), keys, F.lit("other")).isNull().alias("wrong_context_is_null"))


@query("open_transactions", "SELECT xid, min(commit_end_lsn) * 64 AS first_pos, count(*) AS changes, CAST(sum(size) AS BIGINT) AS bytes FROM ev WHERE source_id = 'orders' AND xid % 7 = 0 GROUP BY xid")
def _(spark, d):
    return ingest.open_transactions(_messages(spark, d)).select("xid", "first_pos", "changes", "bytes")


@query("load_scenario", "SELECT o_orderkey + 1 AS xid, CAST(1 AS INTEGER) AS low, CAST(count(*) AS INTEGER) AS high, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey", plain=True)
def _(spark, d):
    """The orders' transactions put together again from a log in which ten of them run side by side."""
    by_tx = ingest.assembled(scenarios.interleaved(table(spark, d, "orders"), table(spark, d, "lineitem"), 10)).groupBy("xid")
    return by_tx.agg(F.min("sequence_number").alias("low"), F.max("sequence_number").alias("high"), F.count(F.lit(1)).alias("n"))


@query("burst_assembly", "SELECT l_suppkey + 1 AS xid, CAST(count(*) AS INTEGER) AS high, count(*) AS n FROM lineitem GROUP BY l_suppkey", plain=True)
def _(spark, d):
    """Each supplier's items as one large transaction."""
    return ingest.assembled(scenarios.bursts(table(spark, d, "lineitem"))).groupBy("xid").agg(F.max("sequence_number").alias("high"), F.count(F.lit(1)).alias("n"))


@query("dead_letter_history", "SELECT sink_id, k, repeat('retryable,', attempt_number - 1) || 'permanent_failure' AS tries, 'pending' AS status FROM att WHERE k % 2 = 0")
def _(spark, d):
    tries = attempts(spark, d).withColumn("last", F.col("attempt_number")).withColumn("attempt_number", F.explode(F.sequence(F.lit(1), "last")))
    ended = F.when(F.col("attempt_number") < F.col("last"), "retryable").when(F.col("k") % 2 == 0, "permanent_failure").otherwise("success")
    history = tries.withColumns({"status": ended, "event_id": F.col("k"), "error": F.lit(None).cast("string")})
    return delivery.dead_letters(history).select("sink_id", F.col("event_id").alias("k"), F.array_join(F.transform("attempt_history", lambda a: a["status"]), ",").alias("tries"), "status")


@query("next_attempts", "SELECT sink_id, k, CAST(attempt_number + 1 AS INTEGER) AS attempt_number, true AS in_bounds FROM att WHERE status = 'retryable'")
def _(spark, d):
    given = attempts(spark, d).withColumn("event_id", F.encode(F.col("k").cast("string"), "UTF-8"))
    delay = exprs.backoff_ms("attempt_number", F.lit(1000), F.lit(300_000), exprs.idempotency_key("sink_id", "event_id"))
    planned = delivery.next_attempts(given.withColumn("retry_in_ms", delay), _AS_OF)
    waits = F.unix_millis("next_retry_at") - F.unix_millis(F.lit(_AS_OF).cast("timestamp"))
    base = F.lit(1000) * F.pow(F.lit(2), F.col("attempt_number") - 2)
    return planned.select("sink_id", F.decode("event_id", "UTF-8").cast("long").alias("k"), "attempt_number", ((waits >= F.floor(base * 0.75)) & (waits <= base * 1.25)).alias("in_bounds"))


def _folder(spark: SparkSession) -> str:
    """A new folder among the shared ones; a temporary one only in local mode without that setting."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or 'file://' + tempfile.mkdtemp(prefix='spark-walflow-')}/cdc-{uuid.uuid4().hex}"


def _store(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The events stored twice, of which the second time adds nothing, and read back."""
    path = _folder(spark)
    if not ingest.ingest(spark, events, path) or ingest.ingest(spark, events, path):
        raise AssertionError("a batch that is stored again adds nothing")
    return ingest.read_events(spark, path)


@query("stored_events", "SELECT source_id, table_name, operation, count(*) AS n, CAST(sum(key_hash) AS BIGINT) AS hashes FROM ek GROUP BY ALL")
def _(spark, d):
    return _store(spark, changes(spark, d)).groupBy("source_id", "table_name", "operation").agg(F.count(F.lit(1)).alias("n"), F.sum("key_hash").alias("hashes"))


@query("consumer_offsets_after_ack", "SELECT p AS partition, commit_end_lsn, sequence_number FROM (SELECT CAST(key_hash % 3 AS INTEGER) AS p, commit_end_lsn, sequence_number, row_number() OVER (PARTITION BY key_hash % 3 ORDER BY commit_end_lsn, sequence_number) AS r FROM ek WHERE source_id = 'orders') WHERE r = 100")
def _(spark, d):
    events, folder = _store(spark, order_changes(spark, d)), _folder(spark)
    group, found = ConsumerGroup(ControlStore(spark, folder), "readers", "orders", 3), []
    for k in range(3):
        b = group.poll(events, f"member{k}")
        last = b.events.agg(F.max(exprs.position()).alias("at")).first()["at"]
        group.ack(b.partition, f"member{k}", b.generation, last["lsn"], last["seq"])
        found.append((b.partition, *group.offset(b.partition)))
    return spark.createDataFrame(found, "partition int, commit_end_lsn long, sequence_number int")


@query("replay_jsonl", f"SELECT {_FMT} AS commit_end_lsn, sequence_number, operation FROM ev WHERE source_id = 'orders' AND commit_end_lsn BETWEEN 102400 AND 1024000 AND operation IN ('update', 'delete')")
def _(spark, d):
    folder = _folder(spark)
    sessions = Replays(ControlStore(spark, f"{folder}/control"))
    sessions.create("again", start={"lsn": 102400}, end={"lsn": 1024000}, operation_filter="update, delete", source_id="orders", destination="jsonl", path=f"{folder}/lines")
    sessions.run("again", order_changes(spark, d).withColumn("id", exprs.event_id()))
    return spark.read.schema("commit_end_lsn string, sequence_number int, operation string").json(f"{folder}/lines")


def _answer(url: str, headers: dict[str, str], payload: str) -> tuple[int, str, None, bool]:
    """A receiver that takes orders and refuses items."""
    return (500 if json.loads(payload)["table_name"] == "lineitem" else 200), "", None, False


@query("delivery_cycle", """SELECT s.id AS sink_id, table_name, t.n AS attempt_number, count(*) AS attempts,
    CASE WHEN s.id = 'gone' THEN 'permanent_failure' WHEN s.id = 'off' THEN 'pending' WHEN table_name = 'orders' THEN 'success' WHEN t.n = 1 THEN 'retryable' ELSE 'permanent_failure' END AS status
    FROM ev, (VALUES (CAST(1 AS INTEGER)), (2)) t(n), (VALUES ('on'), ('gone'), ('off')) s(id)
    WHERE source_id = 'orders' AND (s.id = 'on' OR operation <> 'insert') AND (t.n = 1 OR (s.id = 'on' AND table_name = 'lineitem')) GROUP BY ALL""")
def _(spark, d):
    folder = _folder(spark)
    store, rows = ControlStore(spark, f"{folder}/control"), order_changes(spark, d)
    log = EventLog(spark, f"{folder}/events", store, seconds=3600)
    log.publish(rows, {"orders": rows.agg(F.max("commit_end_lsn")).first()[0]}, {}, "derived", 0, "catalog", log.claim("catalog"))
    registry = Registry(store, {"main": bytes(range(32))}, "main")
    for name, wanted in (("on", None), ("gone", "update, delete"), ("off", "update, delete")):
        registry.add("sinks", name, url="memory:", secret="k", operation_filter=wanted, max_attempts=2, retry_initial_ms=1000, retry_max_ms=1000)
    work = Deliveries(spark, f"{folder}/deliveries", store, log, enqueued=None, most=None)
    work.enqueue(registry.sinks(), "catalog")
    registry.update("sinks", "off", enabled=False)
    sinks = registry.sinks().filter("sink_id <> 'gone'")
    for minute in range(10):
        if not work.tick(sinks, _answer, f"2024-01-01 00:0{minute}:00", "catalog", work.slots):
            break
    names = log.read().select(*ingest.NATURAL_KEY, "table_name")
    return work.attempts().join(names, ingest.NATURAL_KEY).groupBy("sink_id", "table_name", "attempt_number", "status").agg(F.count(F.lit(1)).alias("attempts"))


_FAILED = "e.value < 80"


@query("circuit_states", f"""WITH h AS (SELECT CAST(user_id % 40 AS VARCHAR) AS sink_id, ts, event_id, NOT ({_FAILED}) AS good FROM events e),
    l AS (SELECT sink_id, max(event_id) FILTER (WHERE good) AS good_id, max(ts) AS ended FROM h GROUP BY sink_id),
    c AS (SELECT sink_id, count(*) FILTER (WHERE NOT good AND (good_id IS NULL OR event_id > good_id)) AS failures, any_value(ended) AS ended FROM h JOIN l USING (sink_id) GROUP BY sink_id)
    SELECT sink_id, failures, CASE WHEN failures < 3 THEN 'closed' WHEN epoch_ms(TIMESTAMP '2024-01-30 23:59:00') - epoch_ms(ended) < 600000 THEN 'open' ELSE 'half_open' END AS state FROM c""", plain=True)
def _(spark, d):
    failed = F.expr(_FAILED.replace("e.", ""))
    history = table(spark, d, "events").select((F.col("user_id") % 40).cast("string").alias("sink_id"), F.when(failed, "retryable").otherwise("success").alias("status"), F.col("ts").cast("timestamp").alias("finished_at"), F.col("event_id").alias("attempt_number"))
    return delivery.circuit_states(history, 3, 600_000, "2024-01-30 23:59:00")


@query("stream_capture", f"""SELECT table_name, operation, relation_fingerprint, count(*) AS n, CAST(sum(commit_end_lsn) AS BIGINT) AS positions, CAST(sum(sequence_number) AS BIGINT) AS places, CAST(sum(length(key_text)) AS BIGINT) AS key_letters FROM (
    SELECT *, CASE WHEN table_name = 'lineitem' THEN {_RELATION.format("lineitem", _ITEM_COLUMNS)} WHEN xid >= 2 * ((SELECT max(o_orderkey) FROM orders) // 2 + 1) THEN {_RELATION.format("orders", _ORDER_COLUMNS.format("o_priority"))}
        ELSE {_RELATION.format("orders", _ORDER_COLUMNS.format("o_orderpriority"))} END AS relation_fingerprint FROM ev WHERE source_id = 'orders') GROUP BY ALL""")
def _(spark, d):
    """The order log as files, streamed in two parts, the second by another owner from the same checkpoint, with a relation that changes on the way."""
    folder = _folder(spark)
    messages = _made_once(spark, order_messages(spark, d), folder)
    log = EventLog(spark, f"{folder}/events", ControlStore(spark, f"{folder}/control"), seconds=3600)
    cut = messages.agg(F.max("pos")).first()[0] // 2
    for part, owner in ((messages.filter(F.col("pos") <= cut), "first"), (messages.filter(F.col("pos") > cut), "second")):
        wal.write_log(part, f"{folder}/log", 8)
        run_capture(spark, wal.read_stream(spark, f"{folder}/log"), log, f"{folder}/checkpoint", owner).awaitTermination()
        log.release()
    return _captured(log)


def _made_once(spark: SparkSession, messages: DataFrame, folder: str) -> DataFrame:
    """messages in a table, as the parts of a log are cut out of them several times."""
    with shuffles_dropped(spark):
        messages.write.parquet(f"{folder}/messages")
    return spark.read.parquet(f"{folder}/messages")


def _captured(log: EventLog) -> DataFrame:
    counted = log.read().withColumn("key_text", exprs.normalized_key("key_columns")).groupBy("table_name", "operation", "relation_fingerprint")
    return counted.agg(F.count(F.lit(1)).alias("n"), F.sum("commit_end_lsn").alias("positions"), F.sum("sequence_number").alias("places"), F.sum(F.length("key_text")).alias("key_letters"))


def _published(spark: SparkSession, d: str, cuts: int) -> EventLog:
    """A log of all events, published in batches of consecutive positions."""
    folder, rows = _folder(spark), changes(spark, d)
    log = EventLog(spark, f"{folder}/events", ControlStore(spark, f"{folder}/control"), seconds=3600)
    generation = log.claim("catalog")
    ends = {r["source_id"]: r["at"] for r in rows.groupBy("source_id").agg(F.max("commit_end_lsn").alias("at")).collect()}
    for k in range(cuts):
        part, at = F.lit(False), {}
        for source, end in ends.items():
            low, at[source] = end * k // cuts, end * (k + 1) // cuts
            part = part | ((F.col("source_id") == source) & (F.col("commit_end_lsn") > low) & (F.col("commit_end_lsn") <= at[source]))
        log.publish(rows.filter(part), at, {}, "derived", k, "catalog", generation)
    return log


@query("poll_indexed", f"SELECT p, commit_end_lsn, sequence_number, table_name, operation, key_text FROM (SELECT *, CAST(key_hash % {_PARTS} AS INTEGER) AS p, row_number() OVER (PARTITION BY key_hash % {_PARTS} ORDER BY commit_end_lsn, sequence_number) AS r FROM ek WHERE source_id = 'orders' AND (commit_end_lsn, sequence_number) > (102400, 2)) WHERE r <= 500")
def _(spark, d):
    """The next 500 events of every partition after an offset; the last of the log's three batches is not in the index."""
    log = _published(spark, d, 3)
    index = PositionIndex(log, f"{log.folder}/index", rows_a_file=50_000)
    index.advance(1)
    index.advance(1)
    polled = [index.poll("orders", _PARTS, p, 102400, 2, 500).withColumn("p", F.lit(p)) for p in range(_PARTS)]
    rows = reduce(DataFrame.unionByName, polled)
    return rows.select("p", "commit_end_lsn", "sequence_number", "table_name", "operation", exprs.normalized_key("key_columns").alias("key_text"))


@query("stats_running", f"SELECT source_id, count(*) AS events, count(*) FILTER (WHERE commit_timestamp > TIMESTAMP '{_AS_OF}' - INTERVAL 1 MINUTE AND commit_timestamp <= TIMESTAMP '{_AS_OF}') / 60.0 AS events_per_second, CAST(CAST(epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(max(commit_timestamp)) AS DOUBLE) / 1e6 AS DOUBLE) AS lag_seconds, printf('%.1fs', CAST(epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(max(commit_timestamp)) AS DOUBLE) / 1e6) AS lag_text FROM ev GROUP BY source_id")
def _(spark, d):
    log = _published(spark, d, 3)
    running = RunningStatistics(log, f"{log.folder}/statistics")
    while running.advance(1):
        pass
    return running.look(_AS_OF, by_source=True)


@query("binary_capture", ORACLE_SQL["stream_capture"], plain=True)
def _(spark, d):
    """The order log as the bytes that the database sends, recorded in two parts; the second is streamed by another owner, from the same checkpoint."""
    folder = _folder(spark)
    messages = _made_once(spark, order_messages(spark, d), folder)
    log = EventLog(spark, f"{folder}/events", ControlStore(spark, f"{folder}/control"), seconds=3600)
    cut = (messages.agg(F.max("xid")).first()[0] // 2) * 64  # between two transactions
    for part, owner in ((messages.filter(F.col("pos") < cut), "first"), (messages.filter(F.col("pos") >= cut), "second")):
        binlog.record(part, f"{folder}/log", 8)
        run_capture(spark, binlog.read_stream(spark, f"{folder}/log"), log, f"{folder}/checkpoint", owner).awaitTermination()
        log.release()
    return _captured(log)
