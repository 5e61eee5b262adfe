"""Plans whose shuffles, sorts and copies decide what large inputs cost."""

import re

from pyspark.sql import functions as F

from walflow.functions import exprs
from walflow.operators import ingest
from walflow.operators.control import ControlStore
from walflow.operators.followers import PositionIndex
from walflow.operators.publish import EventLog
from walflow.sources.commerce import order_changes

SF = "/root/testdata/sf0.001"
IMAGE = "map<string,struct<_state:string,value:string>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def messages(spark):
    rows = [("s", 1, "begin", 1, None), ("s", 2, "insert", 1, None), ("s", 3, "insert", 1, None), ("s", 4, "commit", 1, 100), ("s", 5, "begin", 1, None), ("s", 6, "delete", 1, None), ("s", 7, "commit", 1, 200), ("s", 8, "begin", 2, None), ("s", 9, "insert", 2, None)]
    some = spark.createDataFrame(rows, "source_id string, pos long, kind string, xid long, commit_end_lsn long")
    return some.withColumns({c: F.lit(None).cast(t) for c, t in (("commit_timestamp", "timestamp"), ("schema_name", "string"), ("table_name", "string"), ("before", IMAGE), ("after", IMAGE), ("key_columns", "map<string,string>"))})


def test_batch_moves_once(spark, tmp_path):
    """A batch that is settled against a store is dealt once, by ranges, before its hashes are computed, and is not joined."""
    events = spark.read.parquet(_saved(order_changes(spark, SF), f"{tmp_path}/events"))
    store = ingest.stored(events.filter("commit_end_lsn % 2048 = 0"))
    text = plan(ingest.settled(events, store.select(*ingest.NATURAL_KEY, "payload_hash")))
    assert len(re.findall(r"Exchange \w+partitioning", text)) == 1 and "Join" not in text
    new = ingest.settled(events.unionByName(events), store)
    assert sorted(new.columns) == sorted(store.columns)
    want = ingest.stored(events.filter("commit_end_lsn % 2048 <> 0"))
    rows = lambda df: sorted(map(str, df.select("id", "payload_hash", "key_hash", *events.columns).collect()))
    assert rows(new) == rows(want)


def _saved(df, path):
    df.write.parquet(path)
    return path


def test_parts_of_whole_rows(spark):
    """Steps that sort whole rows deal them into more parts than others, and sort a transaction's rows once."""
    parts = ingest.FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ingest.assembled(messages(spark))
    text = plan(rows)
    assert re.search(rf"hashpartitioning\(source_id\S*, xid\S*, {parts}\)", text) and len(re.findall(r"\bSort \[", text)) == 2
    assert sorted((r["xid"], r["commit_end_lsn"], r["sequence_number"], r["operation"]) for r in rows.collect()) == [(1, 100, 1, "insert"), (1, 100, 2, "insert"), (1, 200, 1, "delete")]
    keys = spark.range(40).select(F.lit("s").alias("source_id"), F.col("id").alias("commit_end_lsn"), F.lit(1).alias("sequence_number"))
    fresh = ingest.fresh(keys.unionByName(keys), keys.filter("commit_end_lsn < 10"))
    assert fresh.rdd.getNumPartitions() == parts and sorted(r[1] for r in fresh.collect()) == list(range(10, 40))


def test_index_leaves_out_what_follows(spark, tmp_path):
    """The index keeps no ids and payload hashes, and its polls return them nevertheless."""
    log = EventLog(spark, f"file://{tmp_path}/events", ControlStore(spark, f"file://{tmp_path}/control"), seconds=3600)
    events = order_changes(spark, SF).filter("commit_end_lsn <= 20480")
    log.publish(events, {"orders": 20480}, {}, "q", 0, "a", log.claim("a"))
    index = PositionIndex(log, f"file://{tmp_path}/index")
    assert index.advance() == 1
    kept = index.parts([t for _, t in index.row()["parts"]]).columns
    assert not {"id", "payload_hash"} & set(kept)
    rows = lambda df: [(r["id"], r["payload_hash"], r["key_hash"]) for r in df.collect()]
    assert rows(index.poll("orders", 1, 0, None, None, 1000)) == rows(log.read().orderBy("commit_end_lsn", "sequence_number"))


def test_sorted_map_of_one(spark):
    """A map of one entry is left as it is, and hashes stay what they were."""
    df = spark.createDataFrame([({"b": "1", "a": "2"},), ({"x": "1"},), ({},), (None,)], "m map<string,string>")
    assert [list(r[0].items()) if r[0] is not None else None for r in df.select(exprs.sorted_map("m")).collect()] == [[("a", "2"), ("b", "1")], [("x", "1")], [], None]
    assert "CASE WHEN (size(m" in plan(df.select(exprs.sorted_map("m")))


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_ingest_leaves_no_shuffle_files(spark, tmp_path):
    """A batch's shuffle files go with it, its hashes move as bytes, and its ranges are as fine as other parts of whole rows."""
    events = spark.read.parquet(_saved(order_changes(spark, SF), f"{tmp_path}/events"))
    n, before = events.count(), _shuffle_files(spark)
    assert ingest.ingest(spark, events, f"file://{tmp_path}/store") == n
    assert not {f for f in _shuffle_files(spark) - before if f.endswith(".data")}
    settled = ingest.settled(events, ingest.read_events(spark, f"file://{tmp_path}/store"))
    parts = ingest.FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = plan(settled)
    assert re.search(rf"rangepartitioning\(.*, {parts}\)", text) and "unhex(payload_hash" in text.split("rangepartitioning", 1)[1]
    assert settled.count() == 0
    kept = {"payload_hash": F.lit("no hash")}
    try:
        ingest.settled(events, ingest.read_events(spark, f"file://{tmp_path}/store").withColumns(kept)).count()
        raise AssertionError("what is no hash equals none")
    except Exception as e:
        assert ingest.MISMATCH in str(e)


def test_an_empty_batch_and_remains_of_a_failed_one(spark, tmp_path):
    events = order_changes(spark, SF).filter("commit_end_lsn <= 2048")
    path = f"file://{tmp_path}/s"
    (tmp_path / "s").mkdir()
    assert ingest.ingest(spark, events.limit(0), path) == 0
    n = events.count()
    assert ingest.ingest(spark, events, path) == n and ingest.ingest(spark, events, path) == 0 and ingest.ingest(spark, events.limit(0), path) == 0
    assert ingest.read_events(spark, path).count() == n
