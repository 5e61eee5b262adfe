"""Tables that follow the event log: polls by the index of positions equal scans and read few files; running statistics equal a scan."""

import pytest
from pyspark.sql import functions as F

from walflow.operators import events as ev
from walflow.operators import followers
from walflow.operators.consumer import ConsumerGroup
from walflow.operators.control import ControlStore
from walflow.operators.followers import PositionIndex, RunningStatistics
from walflow.operators.publish import EventLog

IMAGE = "map<string,struct<_state:string,value:string>>"
GIVEN = f"source_id string, xid long, commit_end_lsn long, commit_timestamp timestamp, sequence_number int, schema_name string, table_name string, operation string, before {IMAGE}, after {IMAGE}, key_columns map<string,string>, relation_fingerprint string"


def rows(spark, low, high, source="s", hot=3):
    """Transactions of three events; a third of all events have one key."""
    n = spark.range(low * 3, high * 3)
    key = F.when(F.col("id") % hot == 0, F.lit(0)).otherwise(F.col("id")).cast("string")
    made = n.select(
        F.lit(source).alias("source_id"), F.expr("id div 3").alias("xid"), F.expr("10 * (id div 3) + 10").alias("commit_end_lsn"), F.timestamp_seconds(F.expr("1700000000 + id div 3")).alias("commit_timestamp"), (F.col("id") % 3 + 1).cast("int").alias("sequence_number"),
        F.lit("public").alias("schema_name"), F.lit("t").alias("table_name"), F.lit("insert").alias("operation"), F.lit(None).cast(IMAGE).alias("before"), F.lit(None).cast(IMAGE).alias("after"), F.create_map(F.lit("k"), key).alias("key_columns"), F.lit(None).cast("string").alias("relation_fingerprint"))
    return spark.createDataFrame(made.rdd, GIVEN) if made.schema.simpleString() != spark.createDataFrame([], GIVEN).schema.simpleString() else made


@pytest.fixture
def log(spark, tmp_path):
    return EventLog(spark, f"file://{tmp_path}/events", ControlStore(spark, f"file://{tmp_path}/control"), seconds=3600)


def publish(log, k, events, ends):
    log.publish(events, ends, {}, "st", k, "me", log.row()["generation"] or log.claim("me"))


def seen(df):
    return [tuple(r) for r in df.select("source_id", "commit_end_lsn", "sequence_number", F.hex("id")).collect()]


def test_polls_equal_scans(spark, log, monkeypatch):
    monkeypatch.setattr(followers, "FAN", 2)
    index = PositionIndex(log, f"{log.folder}/index", buckets=12, rows_a_file=40)
    assert index.advance() == 0 and seen(index.poll("007", 4, 1, None, None, 5)) == []
    for k in range(3):
        publish(log, k, rows(spark, 100 * k, 100 * k + 100, "007").unionByName(rows(spark, 30 * k, 30 * k + 30, "7")), {"007": 1000 * (k + 1), "7": 300 * (k + 1)})
        if k < 2:
            assert index.advance() == 1
            assert index.advance() == 0
    assert index.row()["mark"] == 2 and [p[0] for p in index.row()["parts"]] == [1], "two parts became one of the next level"
    for source, n, at, most in [("007", 4, (None, None), 7), ("007", 5, (515, None), 50), ("007", 1, (510, 2), 400), ("007", 24, (20, 1), 10), ("7", 3, (290, 3), 100), ("007", 4, (5000, 0), 3), ("none", 4, (None, None), 3)]:
        for p in range(n) if n < 6 else (0, 13):
            assert seen(index.poll(source, n, p, *at, most)) == seen(ev.poll(log.read(), source, n, p, *at, most)), (source, n, p, at)
    late = rows(spark, 40, 45, "8")
    publish(log, 3, late, {"8": 450})
    assert index.advance() == 2
    publish(log, 4, rows(spark, 0, 5, "8"), {"8": 450})
    assert index.advance() == 1, "a later batch with earlier positions"
    for p in range(2):
        assert seen(index.poll("8", 2, p, None, None, 9)) == seen(ev.poll(log.read(), "8", 2, p, None, None, 9))


def test_files_read_do_not_grow(spark, log):
    index, read = PositionIndex(log, f"{log.folder}/index", buckets=4, rows_a_file=100), []
    for k in range(3):
        publish(log, k, rows(spark, 1000 * k, 1000 * (k + 1)), {"s": 10_000 * (k + 1)})
        index.advance()
        read.append(len(index.poll("s", 4, 1, 40, 1, 20).inputFiles()))
    files = len(index.parts([t for _, t in index.row()["parts"]]).inputFiles())
    assert files > 60 and max(read) <= 3, (files, read)


def test_a_lost_step_leaves_nothing(spark, log):
    publish(log, 0, rows(spark, 0, 10), {"s": 100})
    one, two = (PositionIndex(log, f"{log.folder}/index") for _ in range(2))
    write = one.write

    def slow(df, part):
        write(df, part)
        assert two.advance() == 1

    one.write = slow
    assert one.advance() == 0
    assert one.parts([t for _, t in one.row()["parts"]]).count() == 30
    fs, p = log._fs(f"{log.folder}/index")
    assert len(fs.listStatus(p)) == 1


def test_groups_poll_by_the_index(spark, log):
    publish(log, 0, rows(spark, 0, 50), {"s": 500})
    index = PositionIndex(log, f"{log.folder}/index")
    index.advance()
    group, got = ConsumerGroup(log.store, "g", "s", 2), []
    for _ in range(20):
        b = group.poll(index, "m", 40)
        if not b.issued:
            break
        page = b.events.select("commit_end_lsn", "sequence_number").collect()
        got += [tuple(r) for r in page]
        group.ack(b.partition, "m", b.generation, *max(tuple(r) for r in page))
        group.leases.release(f"lease/{b.partition}", "m", b.generation)
    assert sorted(got) == sorted(tuple(r) for r in log.read().select("commit_end_lsn", "sequence_number").collect())


def test_statistics_equal_a_scan(spark, log, monkeypatch):
    monkeypatch.setattr(followers, "FAN", 2)
    running = RunningStatistics(log, f"{log.folder}/statistics")
    look = lambda df: [tuple(r) for r in df.collect()]
    assert running.advance() == 0 and look(running.look("2023-11-14 22:15:00")) == [(0, 0.0, None, "n/a")]
    for k in range(4):
        publish(log, k, rows(spark, 50 * k, 50 * k + 50, "s").unionByName(rows(spark, 20 * k, 20 * k + 20, "t")), {"s": 500 * (k + 1), "t": 200 * (k + 1)})
        assert running.advance() == 1 and running.advance() == 0
        for as_of in ("2023-11-14 22:13:00", "2023-11-14 22:14:03.5", "2023-11-14 22:14:40", "2023-11-15 00:00:00"):
            assert look(running.look(as_of)) == look(ev.statistics(log.read(), as_of)), (k, as_of)
    by_source = {r["source_id"]: r for r in running.look("2023-11-14 22:14:40", by_source=True).collect()}
    for s in ("s", "t"):
        assert look(ev.statistics(log.read().filter(F.col("source_id") == s), "2023-11-14 22:14:40"))[0] == tuple(by_source[s])[1:]
    files = running.parts([t for _, t in running.row()["parts"]])
    assert files.columns == ["source_id", "at", "n"] and files.count() == 280
