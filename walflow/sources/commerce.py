"""A deterministic change log derived from order tables: for each order one transaction that creates it with its items, and one that ends it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from walflow.sources.wal import COLUMNS, SCHEMA

IMAGE = "map<string,struct<_state:string,value:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image(**columns: Column) -> Column:
    """An image of a row: for each column its state and JSON text."""
    parts = [x for k, v in columns.items() for x in (F.lit(k), F.struct(F.when(v.isNull(), "null").otherwise("value").alias("_state"), v.alias("value")))]
    return F.create_map(*parts)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, xid, commit_end_lsn, commit_timestamp, sequence_number, schema_name, table_name, operation, before, after, key_columns."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    none = F.lit(None).cast(IMAGE)
    row = image(o_orderkey=F.col("o_orderkey").cast("string"), o_custkey=F.col("o_custkey").cast("string"), o_orderstatus=_quoted(F.col("o_orderstatus")))
    key = F.create_map(F.lit("o_orderkey"), F.col("o_orderkey").cast("string"))
    base = lambda xid, lsn, seq, name, op, before, after, k: [F.lit("orders").alias("source_id"), xid.alias("xid"), lsn.alias("commit_end_lsn"), F.col("o_orderdate").alias("commit_timestamp"), seq.cast("int").alias("sequence_number"), F.lit("public").alias("schema_name"), F.lit(name).alias("table_name"), op.alias("operation"), before.alias("before"), after.alias("after"), k.alias("key_columns")]
    k = F.col("o_orderkey")
    created = orders.select(*base(2 * (k + 1), 1024 * (k + 1), F.lit(1), "orders", F.lit("insert"), none, row, key))
    ended = orders.filter(F.col("o_orderstatus").isin("F", "P")).select(
        *base(2 * (k + 1) + 1, 1024 * (k + 1) + 512, F.lit(1), "orders", F.when(F.col("o_orderstatus") == "F", "update").otherwise("delete"), F.when(F.col("o_orderstatus") == "P", row), F.when(F.col("o_orderstatus") == "F", row), key)
    )
    # items alike in these columns make the same events, whichever comes first, so the columns behind them decide nothing and need not move
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber"))
    numbered = items.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").withColumn("place", place).join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == k)
    text = lambda c: F.col(c).cast("string")
    item = image(l_orderkey=text("l_orderkey"), l_partkey=text("l_partkey"), l_linenumber=text("l_linenumber"))
    item_key = F.create_map(F.lit("l_orderkey"), text("l_orderkey"), F.lit("l_linenumber"), text("l_linenumber"))
    added = numbered.select(*base(2 * (k + 1), 1024 * (k + 1), 1 + F.col("place"), "lineitem", F.lit("insert"), none, item, item_key))
    return created.unionByName(ended).unionByName(added)


#: Column types of the order tables by the source database's numbers: eight-byte and four-byte integers, doubles, timestamps, texts.
_TYPES = {"bigint": 20, "int": 23, "double": 701, "timestamp_ntz": 1114, "timestamp": 1114, "string": 1043}
_PLACES = 64  # positions a transaction takes in the log, which holds its begin, at most 14 changes and its commit


def relation_columns(rows: DataFrame, keys: tuple[str, ...], renamed: dict[str, str] | None = None) -> list[tuple[str, int, bool, int, bool]]:
    """A relation's columns as the log's messages describe them: name, type, nullable, position from 1, whether a key column."""
    return [((renamed or {}).get(n, n), _TYPES[t], n not in keys, i, n in keys) for i, (n, t) in enumerate(rows.dtypes, 1)]


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order log as its messages (see wal.SCHEMA), with whole rows: the relations of both tables first, and before the middle order a new version of `orders`, whose
    priority column is renamed."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    middle = (orders.agg(F.max("o_orderkey")).first()[0] or 0) // 2
    k = F.col("o_orderkey")
    full = lambda rows: F.array(*[F.struct(F.when(F.col(c).isNull(), "null").otherwise("value").alias("state"), F.col(c).cast("string").alias("text")) for c in rows.columns])

    def rows(df: DataFrame, xid: Column, place: Column, kind: Column, **given: Column) -> DataFrame:
        fields = {f.name: f.dataType for f in spark.createDataFrame([], SCHEMA).schema}
        have = {"source_id": F.lit("orders"), "xid": xid, "pos": xid * _PLACES + place, "kind": kind} | given
        return df.select(*[have.get(c, F.lit(None)).cast(t).alias(c) for c, t in fields.items()])

    create, end = 2 * (k + 1), 2 * (k + 1) + 1
    ended = orders.filter(F.col("o_orderstatus").isin("F", "P"))
    parts = []
    for df, xid, lsn in ((orders, create, 1024 * (k + 1)), (ended, end, 1024 * (k + 1) + 512)):
        parts += [rows(df, xid, F.lit(0), F.lit("begin")), rows(df, xid, F.lit(40), F.lit("commit"), commit_end_lsn=lsn, commit_timestamp=F.col("o_orderdate"))]
    gone = F.col("o_orderstatus") == "P"
    parts += [rows(orders, create, F.lit(1), F.lit("insert"), oid=F.lit(1), new=full(orders))]
    parts += [rows(ended, end, F.lit(1), F.when(gone, "delete").otherwise("update"), oid=F.lit(1), old=F.when(gone, full(orders)), new=F.when(~gone, full(orders)))]
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*items.columns))
    known = items.withColumn("place", place).join(orders.select(k), F.col("l_orderkey") == k, "left_semi")
    parts += [rows(known, 2 * (F.col("l_orderkey") + 1), 1 + F.col("place"), F.lit("insert"), oid=F.lit(2), new=full(items))]
    relations = [
        (0, 1, "orders", relation_columns(orders, ("o_orderkey",))),
        (1, 2, "lineitem", relation_columns(items, ("l_orderkey", "l_linenumber"))),
        (2 * (middle + 1) * _PLACES - 1, 1, "orders", relation_columns(orders, ("o_orderkey",), {"o_orderpriority": "o_priority"})),
    ]
    described = spark.createDataFrame([("orders", pos, "relation", oid, "public", name, "default", cols) for pos, oid, name, cols in relations], f"source_id string, pos long, kind string, oid long, schema_name string, table_name string, replica_identity string, columns {COLUMNS}")
    return reduce(DataFrame.unionByName, parts).unionByName(described, allowMissingColumns=True)


def activity_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a second source: one transaction with one insert each."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.lit("activity").alias("source_id"), (i + 1).alias("xid"), (16 * (i + 1)).alias("commit_end_lsn"), F.col("ts").alias("commit_timestamp"), F.lit(1).alias("sequence_number"), F.lit("public").alias("schema_name"),
        F.lit("events").alias("table_name"), F.lit("insert").alias("operation"), F.lit(None).cast(IMAGE).alias("before"), image(event_id=i.cast("string"), user_id=F.col("user_id").cast("string"), event_type=_quoted(F.col("event_type"))).alias("after"),
        F.create_map(F.lit("user_id"), F.col("user_id").cast("string")).alias("key_columns"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_changes(spark, sf_dir).unionByName(activity_changes(spark, sf_dir))
