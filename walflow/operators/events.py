"""Reading the event store: lists, lookups, transactions, polls, replay ranges, statistics."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from walflow.functions.exprs import after, estimated_bytes, format_lsn, operation_listed, partition_of

POSITION = ("commit_end_lsn", "sequence_number")


def matching(**wanted: str | None) -> Column:
    """All of the given equalities; null or empty means any."""
    return reduce(and_, [F.col(k) == v for k, v in wanted.items() if v], F.lit(True))


def newest(events: DataFrame, limit: int = 100, **wanted: str | None) -> DataFrame:
    """The newest events that match, by position; ties between sources by source."""
    return events.filter(matching(**wanted)).orderBy(F.desc("commit_end_lsn"), F.desc("sequence_number"), "source_id").limit(limit)


def by_id(events: DataFrame, hex_id: str) -> DataFrame:
    return events.filter(F.col("id") == F.unhex(F.lit(hex_id)))


def transactions(events: DataFrame) -> DataFrame:
    """A row for each transaction with its number of events and estimated bytes."""
    return events.groupBy("source_id", "xid", "commit_end_lsn", "commit_timestamp").agg(F.count(F.lit(1)).alias("event_count"), F.sum(estimated_bytes()).alias("total_bytes"))


def transaction_events(events: DataFrame, source_id: str, xid: int) -> DataFrame:
    """The events of a source's first transaction with this xid, in order."""
    own = events.filter((F.col("source_id") == source_id) & (F.col("xid") == xid))
    first = own.agg(F.min("commit_end_lsn").alias("_first"))
    return own.join(F.broadcast(first), F.col("commit_end_lsn") == F.col("_first")).drop("_first").orderBy("sequence_number")  # one row


def poll(events: DataFrame, source_id: str, partitions: int, partition: int, lsn: int | None, seq: int | None, most: int) -> DataFrame:
    """The next events of one partition after a position: position and partition are filtered before the limit, so no partition starves.

    events has key_hash, kept at ingest.
    """
    mine = (F.col("source_id") == source_id) & after(lsn, seq) & (partition_of("key_hash", partitions) == partition)
    return events.filter(mine).orderBy(*POSITION).limit(most)


def replay_range(events: DataFrame, start: dict | None = None, end: dict | None = None, schema_filter: str | None = None, table_filter: str | None = None, operation_filter: str | None = None, source_id: str | None = None) -> DataFrame:
    """Events between two bounds, both included; a bound is {'lsn': n}, {'timestamp': t} or {'event_id': hex}. Empty filters mean any."""
    out = events.filter(matching(source_id=source_id, schema_name=schema_filter, table_name=table_filter)).filter(operation_listed("operation", F.lit(operation_filter)))
    for bound, low in ((start, True), (end, False)):
        if not bound:
            continue
        ((kind, value),) = bound.items()
        if kind == "event_id":
            at = events.filter(F.col("id") == F.unhex(F.lit(value))).select(F.col("source_id").alias("_s"), F.struct(*POSITION).alias("_at")).limit(1)
            side = F.struct(*POSITION) >= F.col("_at") if low else F.struct(*POSITION) <= F.col("_at")
            out = out.join(F.broadcast(at), (F.col("source_id") == F.col("_s")) & side).drop("_s", "_at")  # one row
        else:
            c = F.col("commit_end_lsn") if kind == "lsn" else F.col("commit_timestamp")
            v = F.lit(value) if kind == "lsn" else F.lit(value).cast(events.schema["commit_timestamp"].dataType)
            out = out.filter(c >= v if low else c <= v)
    return out


def lag_text() -> Column:
    """lag_seconds with one decimal; n/a where there are no events."""
    return F.when(F.col("lag_seconds").isNull(), "n/a").otherwise(F.format_string("%.1fs", "lag_seconds"))


def statistics(events: DataFrame, as_of: str) -> DataFrame:
    """Events, events a second over the minute before as_of, and the age of the newest event, as seconds and as text."""
    t = F.lit(as_of).cast("timestamp")
    at = F.col("commit_timestamp").cast("timestamp")
    return events.agg(
        F.count(F.lit(1)).alias("events"), (F.count_if((at > t - F.expr("interval 1 minute")) & (at <= t)) / 60.0).alias("events_per_second"), ((F.unix_micros(t) - F.unix_micros(F.max(at))) / 1e6).alias("lag_seconds")
    ).withColumn("lag_text", lag_text())


def partition_lag(events: DataFrame, offsets: DataFrame, source_id: str, partitions: int) -> DataFrame:
    """For each partition the events after its offset (partition, commit_end_lsn, sequence_number); a partition without an offset has read nothing."""
    at = offsets.select("partition", F.struct(*POSITION).alias("_at"))
    placed = events.filter(F.col("source_id") == source_id).withColumn("partition", partition_of("key_hash", partitions))
    left = placed.join(F.broadcast(at), "partition", "left")  # a row for each partition of the group
    return left.groupBy("partition").agg(F.count_if(F.col("_at").isNull() | (F.struct(*POSITION) > F.col("_at"))).alias("behind"), F.max(F.struct(*POSITION)).alias("_end")).select("partition", "behind", format_lsn("_end.commit_end_lsn").alias("end_lsn"))


def sequences(events: DataFrame) -> DataFrame:
    """Each transaction's first and last sequence number, and whether its numbers are 1..n."""
    by_tx = events.groupBy("source_id", "commit_end_lsn").agg(F.min("sequence_number").alias("low"), F.max("sequence_number").alias("high"), F.count(F.lit(1)).alias("n"))
    return by_tx.withColumn("gapless", (F.col("low") == 1) & (F.col("high") == F.col("n")))


def sequence_gaps(events: DataFrame) -> DataFrame:
    """Transactions whose sequence numbers are not 1..n."""
    return sequences(events).filter("not gapless").drop("gapless")


def source_positions(events: DataFrame, persisted: Column) -> DataFrame:
    """For each source the last position received, the last that is persisted, and the bytes of log between them."""
    at = events.groupBy("source_id").agg(F.max("commit_end_lsn").alias("received"), F.max(F.when(persisted, F.col("commit_end_lsn"))).alias("persisted"))
    return at.withColumn("lag_bytes", F.greatest(F.lit(0), F.col("received") - F.coalesce("persisted", F.lit(0))))


def end_offsets(events: DataFrame, partitions: int) -> DataFrame:
    """The last position of each partition: where a group that has read everything stands."""
    rows = events.groupBy(partition_of("key_hash", partitions).alias("partition")).agg(F.max(F.struct(*POSITION)).alias("at"))
    return rows.select("partition", *[F.col(f"at.{c}").alias(c) for c in POSITION])


def latest_rows(events: DataFrame, upto_lsn: int | None = None) -> DataFrame:
    """The state of each key after all its changes (up to a position): the last image, without deleted keys."""
    some = events if upto_lsn is None else events.filter(F.col("commit_end_lsn") <= upto_lsn)
    last = some.withColumn("row_key", F.to_json("key_columns")).groupBy("source_id", "table_name", "row_key").agg(F.max_by(F.struct("operation", "after", "commit_end_lsn"), F.struct(*POSITION)).alias("last"))
    return last.filter(F.col("last.operation") != "delete").select("source_id", "table_name", "row_key", "last.after", "last.commit_end_lsn")


def change_rates(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Changes by table, operation and time window."""
    w = F.window(F.col("commit_timestamp").cast("timestamp"), width, slide) if slide else F.window(F.col("commit_timestamp").cast("timestamp"), width)
    return events.groupBy("table_name", "operation", w.alias("w")).agg(F.count(F.lit(1)).alias("changes")).select("table_name", "operation", F.col("w.start").alias("window_start"), "changes")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Bursts of a source's changes of one key, apart by at least gap."""
    key = F.to_json("key_columns").alias("row_key")
    return events.groupBy("source_id", key, F.session_window(F.col("commit_timestamp").cast("timestamp"), gap).alias("s")).agg(F.count(F.lit(1)).alias("changes")).select("source_id", "row_key", F.col("s.start").alias("session_start"), "changes")


RELATIONS_BROADCAST = 100_000


def as_of_relation(rows: DataFrame, relations: DataFrame) -> DataFrame:
    """rows (source_id, oid, pos, ...) with the fingerprint of the source's latest relation (source_id, oid, pos, fingerprint) at or before them, null if there is none.

    Relations become intervals, each up to the next of its oid; relations are few, and so only they are sorted. Rows meet the intervals where they are, if these
    are at most RELATIONS_BROADCAST, and else by a join on oid, which adaptive execution splits for a hot relation; no task holds a relation's history.
    """
    w = Window.partitionBy("source_id", "oid").orderBy("pos")
    spans = relations.dropDuplicates(["source_id", "oid", "pos"]).select(F.col("source_id").alias("_source"), F.col("oid").alias("_oid"), F.col("pos").alias("_from"), F.lead("pos").over(w).alias("_to"), F.col("fingerprint").alias("relation_fingerprint"))
    few = relations.limit(RELATIONS_BROADCAST + 1).count() <= RELATIONS_BROADCAST
    inside = (F.col("source_id") == F.col("_source")) & (F.col("oid") == F.col("_oid")) & (F.col("pos") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("pos") < F.col("_to")))
    return rows.join(F.broadcast(spans) if few else spans, inside, "left").drop("_source", "_oid", "_from", "_to")
