"""Loads as write-ahead log messages, of order tables or of numbers alone: many small transactions interleaved, or very large ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from walflow.sources.commerce import IMAGE, image

#: Writers, transactions a second and writer, items a transaction.
SCENARIOS = {"light": (1, 10, 10), "medium": (10, 100, 50), "heavy": (50, 500, 100)}


def _message(kind: Column, xid: Column, pos: Column, lsn: Column, at: Column, row: Column) -> list[Column]:
    change = kind == "insert"
    return [
        F.lit("load").alias("source_id"), pos.alias("pos"), kind.alias("kind"), xid.alias("xid"), F.when(kind == "commit", lsn).alias("commit_end_lsn"), F.when(kind == "commit", at).alias("commit_timestamp"),
        F.when(change, "public").alias("schema_name"), F.when(change, "order_items").alias("table_name"), F.lit(None).cast(IMAGE).alias("before"), F.when(change, image(id=row.cast("string"), order_id=xid.cast("string"))).alias("after"),
        F.when(change, F.create_map(F.lit("id"), row.cast("string"))).alias("key_columns"),
    ]


def load(spark: SparkSession, name: str, seconds: int) -> DataFrame:
    """Messages of a scenario. The transactions of one tick run side by side: their messages take turns, item by item."""
    writers, ticks, items = SCENARIOS[name]
    n = F.col("id")
    steps = items + 2
    tx, tick = n % writers + F.floor(n / (writers * steps)) * writers, F.floor(n / (writers * steps))
    step = F.floor(n / writers) % steps
    kind = F.when(step == 0, "begin").when(step == items + 1, "commit").otherwise("insert")
    at = F.timestamp_micros(F.lit(1704067200000000) + (tick * 1_000_000 / ticks).cast("long")).cast("timestamp_ntz")
    return spark.range(writers * ticks * seconds * steps).select(*_message(kind, tx + 1, n, n * 16 + 16, at, tx * items + step))


STEPS = 64  # more than an order's messages


def _items(items: DataFrame) -> DataFrame:
    """Items with their place within their order."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*items.columns)))


def interleaved(orders: DataFrame, items: DataFrame, writers: int) -> DataFrame:
    """Messages of one transaction for each order, with an insert for each of its items; the transactions of `writers` orders in a row run side by side and take turns."""
    k = F.col("o_orderkey")
    counted = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    ends = orders.select("o_orderkey", "o_orderdate").join(counted, "o_orderkey", "left").select("o_orderkey", "o_orderdate", F.explode(F.array(F.lit(0), F.coalesce("n", F.lit(0)) + 1)).alias("step"))
    ends = ends.select("o_orderkey", "o_orderdate", F.col("step").cast("long").alias("step"), F.when(F.col("step") == 0, "begin").otherwise("commit").alias("kind"), F.lit(None).cast("long").alias("item"))
    inner = _items(items).join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == k).select("o_orderkey", "o_orderdate", F.col("place").cast("long").alias("step"), F.lit("insert").alias("kind"), F.col("l_partkey").alias("item"))
    pos = (F.floor(k / writers) * STEPS + F.col("step")) * writers + k % writers
    return ends.unionByName(inner).select(*_message(F.col("kind"), k + 1, pos, pos * 16 + 16, F.col("o_orderdate"), F.col("item")))


def bursts(items: DataFrame) -> DataFrame:
    """Messages of one large transaction for each supplier, which inserts all of the supplier's items in the order of their orders."""
    supplier, last = F.col("l_suppkey"), F.lit(1 << 62)
    ends = items.select("l_suppkey").distinct().select("l_suppkey", F.explode(F.array(F.struct(F.lit("begin").alias("kind"), F.lit(-1).cast("long").alias("pos")), F.struct(F.lit("commit").alias("kind"), last.alias("pos")))).alias("m"))
    ends = ends.select("l_suppkey", "m.kind", "m.pos", F.lit(None).cast("long").alias("item"))
    inner = _items(items).select("l_suppkey", F.lit("insert").alias("kind"), (F.col("l_orderkey") * STEPS + F.col("place")).alias("pos"), F.col("l_partkey").alias("item"))
    return ends.unionByName(inner).select(*_message(F.col("kind"), supplier + 1, F.col("pos"), supplier * 16 + 16, F.lit("2024-01-01").cast("timestamp_ntz"), F.col("item")))
