"""Transaction assembly and idempotent ingestion."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from walflow.functions.exprs import estimated_bytes, event_id, fnv1a32, normalized_key, payload_hash
from walflow.functions.session import shuffles_dropped
from walflow.operators.control import Checkpoints

NATURAL_KEY = ["source_id", "commit_end_lsn", "sequence_number"]
#: Whole rows are sorted in so many times as many parts as Spark's other shuffles have.
FINER = 4
MARKERS_A_TASK = 100_000


MISMATCH = "two payloads under the natural key "


class HashMismatch(ValueError):
    """A replayed event differs from the one that is stored under its natural key."""


def finely(rows: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys, before a step that sorts whole rows by them; the step needs no shuffle of its own."""
    return rows.repartition(_fine(rows.sparkSession), *keys)


def _fine(spark: SparkSession) -> int:
    return FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))


def assembled(messages: DataFrame) -> DataFrame:
    """WAL messages (source_id, pos, kind, xid, commit_end_lsn, commit_timestamp, schema_name, table_name, before, after, key_columns) -> committed events.

    kind: begin, commit, abort, insert, update, delete. A transaction starts at its begin, so a reused xid makes a new one. Changes of transactions without a
    commit, or with an abort, are left out; sequence numbers count a transaction's changes from 1 in the order of the log.
    """
    by_xid = Window.partitionBy("source_id", "xid").orderBy("pos")
    numbered = finely(messages, "source_id", "xid").withColumn("_begin", F.max(F.when(F.col("kind") == "begin", F.col("pos"))).over(by_xid.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    tx = Window.partitionBy("source_id", "xid", "_begin").orderBy("pos")  # one order for all of it, so that rows are sorted once
    ended = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c))).over(tx.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    closed = numbered.withColumns({"_lsn": ended("commit", "commit_end_lsn"), "_at": ended("commit", "commit_timestamp"), "_abort": ended("abort", "pos")})
    changes = closed.filter(F.col("kind").isin("insert", "update", "delete") & F.col("_lsn").isNotNull() & F.col("_abort").isNull())
    seq = F.row_number().over(tx)
    return changes.select("source_id", "xid", F.col("_lsn").alias("commit_end_lsn"), F.col("_at").alias("commit_timestamp"), seq.alias("sequence_number"), "schema_name", "table_name", F.col("kind").alias("operation"), "before", "after", "key_columns")


def open_transactions(messages: DataFrame) -> DataFrame:
    """The transactions of each source that have begun and not ended: xid, first position, changes and estimated bytes so far."""
    last = F.max(F.when(F.col("kind") == "begin", F.col("pos"))).over(Window.partitionBy("source_id", "xid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = messages.withColumn("first_pos", last).filter("first_pos is not null").withColumn("size", F.when(F.col("kind").isin("insert", "update", "delete"), estimated_bytes()))
    by_tx = runs.groupBy("source_id", "xid", "first_pos").agg(F.count("size").alias("changes"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.col("kind").isin("commit", "abort")).alias("ends"))
    return by_tx.filter("ends = 0").drop("ends")


ENDS = ("commit", "abort", "abandoned")


class LimitExceeded(ValueError):
    """More open transactions, or a larger one, than allowed."""


def first_beyond(markers: DataFrame, opened: DataFrame, most_open: int, apart: bool = False) -> Row | None:
    """The first marker, in the order of each source's log, at which a transaction is too large or a source has more than most_open open ones.

    opened (source_id, xid): those open before. A source's markers are added up in one task, or, if apart, in ranges of positions with about MARKERS_A_TASK of them; then they are read several times.
    """
    own = Window.partitionBy("source_id", "xid").orderBy("pos")
    was = opened.select("source_id", "xid", F.lit(1).alias("was"))
    steps = markers.filter(F.col("what").isin("begin", "large", *ENDS)).join(F.broadcast(was), ["source_id", "xid"], "left")  # at most most_open rows a source
    before = F.coalesce(F.when(F.lag("what").over(own).isin("begin", "large"), 1).when(F.lag("what").over(own).isNotNull(), 0), F.col("was"), F.lit(0))
    delta = F.when(F.col("what") == "begin", 1 - before).when(F.col("what").isin(*ENDS), -before).otherwise(0)
    base = opened.groupBy("source_id").agg(F.count(F.lit(1)).alias("base"))
    counted = steps.withColumn("delta", delta).join(F.broadcast(base), "source_id", "left")
    place, earlier = ["source_id"], F.lit(0)
    n, low, high = markers.agg(F.count(F.lit(1)), F.min("pos"), F.max("pos")).first() if apart else (0, 0, 0)
    if n > MARKERS_A_TASK:
        width = (high - low) // (n // MARKERS_A_TASK + 1) + 1
        place, counted = ["source_id", "range"], counted.withColumn("range", F.floor((F.col("pos") - low) / width))
        up_to = Window.partitionBy("source_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        sums = counted.groupBy(*place).agg(F.sum("delta").alias("sum")).select(*place, F.coalesce(F.sum("sum").over(up_to), F.lit(0)).alias("earlier"))  # a row a range
        counted, earlier = counted.join(sums, place), F.col("earlier")
    open_now = F.coalesce("base", F.lit(0)) + earlier + F.sum("delta").over(Window.partitionBy(*place).orderBy("pos"))
    bad = counted.withColumn("open", open_now).filter((F.col("what") == "large") | ((F.col("what") == "begin") & (F.col("open") > most_open)))
    return (bad.orderBy("pos", "source_id").select("source_id", "xid", "pos", "what", "open", "changes", "bytes").head(1) or [None])[0]


def check_open(messages: DataFrame, most_open: int = 10, max_events: int = 10_000, max_bytes: int = 256 << 20) -> DataFrame:
    """open_transactions(), after a check of the limits in the order of each source's log. Raises LimitExceeded with the first message beyond them, the one at which the stream stops too."""
    by_xid = Window.partitionBy("source_id", "xid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    change = F.col("kind").isin("insert", "update", "delete")
    runs = messages.withColumns({"first_pos": F.max(F.when(F.col("kind") == "begin", F.col("pos"))).over(by_xid), "closed": F.max(F.when(F.col("kind").isin("commit", "abort"), F.col("pos"))).over(by_xid)})
    inside = change & F.col("first_pos").isNotNull() & (F.col("closed").isNull() | (F.col("closed") < F.col("first_pos")))
    tx = Window.partitionBy("source_id", "xid", "first_pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.when(inside, estimated_bytes())
    counted = runs.withColumns({"changes": F.count(size).over(tx), "bytes": F.coalesce(F.sum(size).over(tx), F.lit(0))})
    large = inside & ((F.col("changes") > max_events) | (F.col("bytes") > max_bytes))
    markers = counted.withColumn("what", F.when(large, "large").when(F.col("kind").isin("begin", "commit", "abort"), F.col("kind"))).filter("what is not null")
    if bad := first_beyond(markers.select("what", "source_id", "xid", "pos", "changes", "bytes"), messages.select("source_id", "xid").limit(0), most_open):
        raise LimitExceeded(f"at position {bad['pos']}: {json.dumps(bad.asDict())}")
    return open_transactions(messages)


def stored(events: DataFrame) -> DataFrame:
    """Events as the store keeps them: with id, payload hash and the partition hash of the key."""
    return events.withColumns({"id": event_id(), "payload_hash": payload_hash(), "key_hash": fnv1a32(normalized_key("key_columns"))})


def mismatches(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of the batch whose natural key is stored with another payload."""
    have = store.select(*NATURAL_KEY, F.col("payload_hash").alias("_stored"))
    return batch.join(have, NATURAL_KEY).filter(F.col("payload_hash") != F.col("_stored")).drop("_stored")


def fresh(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of the batch that are not stored yet, once each, without a look at payloads."""
    have = finely(store.select(*NATURAL_KEY), *NATURAL_KEY)
    return finely(batch, *NATURAL_KEY).dropDuplicates(NATURAL_KEY).join(have, NATURAL_KEY, "left_anti")


def settled(events: DataFrame, store: DataFrame | None) -> DataFrame:
    """Events of a batch that are not in the store yet, once each and as stored() makes them. The query fails where one natural key has two payloads, in the batch or in the store.

    The batch moves once, before anything is computed of it, by ranges of the natural key; the store's keys and hashes (store: natural key and payload_hash; None for an
    empty one) are dealt with it, each in front of the events of its key. So rows of one key follow each other and are compared with the one before them. Hashes move as bytes,
    since hexadecimal digits take twice the room, which Spark's shuffles do not win back. As whole rows are sorted, ranges are as fine as finely() deals.
    """
    rows = events.withColumn("_stored", F.lit(None).cast("binary"))
    if store is not None:
        kept = F.coalesce(F.unhex("payload_hash"), F.encode("payload_hash", "UTF-8"))  # what is no hash equals none
        rows = rows.unionByName(store.select(*NATURAL_KEY, kept.alias("_stored")), allowMissingColumns=True)
    order = [*NATURAL_KEY, F.col("_stored").desc_nulls_last()]
    dealt = rows.repartitionByRange(_fine(rows.sparkSession), *NATURAL_KEY).sortWithinPartitions(*order)
    hashed = dealt.withColumn("_hash", F.when(F.col("_stored").isNull(), F.unhex(payload_hash())).otherwise(F.col("_stored")))
    by_key = Window.partitionBy(*NATURAL_KEY).orderBy(F.col("_stored").desc_nulls_last())
    placed = hashed.withColumns({"_before": F.lag("_hash").over(by_key), "_n": F.row_number().over(by_key)})
    text = F.concat(F.lit(MISMATCH), F.to_json(F.struct(*NATURAL_KEY)))
    new = placed.filter(F.when(F.col("_before") != F.col("_hash"), F.raise_error(text).cast("boolean")).otherwise((F.col("_n") == 1) & F.col("_stored").isNull()))
    given = {"id": event_id(), "payload_hash": F.lower(F.hex("_hash")), "key_hash": fnv1a32(normalized_key("key_columns"))}
    return new.withColumns(given).select(*events.columns, *given)


def written(rows: DataFrame, path: str, mode: str = "append") -> int:
    """Writes what settled() gives by source and table, in files of narrow ranges of positions, and returns its number. Raises HashMismatch, with nothing written, for settled()'s failure.

    Ids, which compression cannot shorten, are left out: they follow from the natural key, and read_events() gives them.
    """
    seen = Observation()
    # the ranges are settled()'s, so that a hot table's batch is many tasks' work
    ordered = rows.sortWithinPartitions("source_id", "table_name", "commit_end_lsn", "sequence_number").observe(seen, F.count(F.lit(1)).alias("n"))
    try:
        with shuffles_dropped(rows.sparkSession):
            ordered.drop("id").write.mode(mode).option("compression", "zstd").partitionBy("source_id", "table_name").parquet(path)
    except Exception as e:
        if MISMATCH in str(e):
            raise HashMismatch(str(e).split(MISMATCH, 1)[1].split("}")[0] + "}") from e
        raise
    return seen.get["n"]


def read_events(spark: SparkSession, *paths: str, base: str | None = None) -> DataFrame:
    """Stored events with their ids. Sources and tables are texts as they were given, though folder names such as 007 look like numbers."""
    reader = spark.read.option("basePath", base) if base else spark.read
    events = reader.parquet(*paths)
    texts = T.StructType([T.StructField(f.name, T.StringType() if f.name in ("source_id", "table_name") else f.dataType) for f in events.schema])
    events = events if events.schema == texts else reader.schema(texts).parquet(*paths)
    return events if "id" in events.columns else events.withColumn("id", event_id())


def ingest_fenced(spark: SparkSession, batch: DataFrame, path: str, checkpoints: Checkpoints, source: str, owner: str, generation: int) -> int:
    """ingest() by the owner of a source's checkpoint, whose positions follow: received before the events are stored, persisted after.

    A caller that has lost the checkpoint gets Fenced. If it loses it while it writes, what it wrote are the same events that the new owner will find stored,
    and the position stays the new owner's. A batch without events, of transactions without changes, may carry the position alone (see Checkpoints.advance()).
    """
    end = batch.agg(F.max("commit_end_lsn")).first()[0]
    at = checkpoints.get(source)
    checkpoints.advance(source, owner, generation, received=max(at["received"], end or 0))
    n = ingest(spark, batch, path)
    checkpoints.advance(source, owner, generation, persisted=max(checkpoints.get(source)["persisted"], end or 0))
    return n


def ingest(spark: SparkSession, batch: DataFrame, path: str) -> int:
    """Appends what is new of a batch of events to the Parquet store at path and returns the number of events added.

    Safe to repeat: stored events are recognised by their natural key. Raises HashMismatch, and adds nothing, if one of them differs, or if the batch itself
    has two versions of an event. The store is read between the batch's first and last position.
    """
    if not _holds_events(spark, path):  # nor do the remains of a first batch that failed
        return written(settled(batch, None), path)
    span = batch.agg(F.min("commit_end_lsn").alias("low"), F.max("commit_end_lsn").alias("high")).first()
    if span["low"] is None:
        return 0
    return written(settled(batch, read_events(spark, path).filter(F.col("commit_end_lsn").between(span["low"], span["high"]))), path)


def _holds_events(spark: SparkSession, path: str) -> bool:
    parts = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/source_id=*")
    return len(parts.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(parts) or []) > 0
