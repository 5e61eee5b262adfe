"""Tables that follow an event log: an index of positions and running statistics.

A step reads only the log's batches behind the table's mark and writes them as a new part; then one compare and set moves the mark and the list of parts together, so a
batch is in the table once, whoever else takes the same step. FAN parts of a level are rewritten as one of the next level, so a row is
rewritten a logarithmic number of times and the number of parts grows as slowly. Parts that were merged stay until the next merge, for those who still read them.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walflow.functions.exprs import after, event_id, partition_of, payload_hash
from walflow.operators.events import POSITION, lag_text
from walflow.operators.publish import EventLog

TABLE = "followers"
FAN = 8
NEW = {"mark": 0, "parts": [], "retired": [], "totals": {}}


class Follower:
    def __init__(self, log: EventLog, folder: str, name: str) -> None:
        self.log, self.spark, self.folder, self.name = log, log.spark, folder.rstrip("/"), name

    def row(self) -> dict:
        return self.log.store.read(TABLE)[1].get(self.name) or dict(NEW)

    def write(self, rows: DataFrame, part: str) -> None:
        raise NotImplementedError

    def prepared(self, events: DataFrame) -> DataFrame:
        raise NotImplementedError

    def totals(self, part: str, before: dict) -> dict:
        """What the control store holds of the table: bounded by the number of sources."""
        return before

    def merged(self, rows: DataFrame) -> DataFrame:
        return rows

    def parts(self, tokens: list[str], kind: str = "data") -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{t}/{kind}" for t in tokens])

    def advance(self, most: int = 1000) -> int:
        """Takes in up to `most` batches behind the mark and returns their number; 0 without a look at any event if there are none, or if another caller did it meanwhile."""
        row = self.row()
        last = min(self.log.row()["number"], row["mark"] + most)
        if last <= row["mark"]:
            return 0
        token, made = uuid.uuid4().hex, []
        self.write(self.prepared(self.log.read((row["mark"] + 1, last))), token)
        made.append(token)
        totals, parts, gone, level = self.totals(token, row["totals"]), [*row["parts"], [0, token]], [], 0
        while len(same := [t for l, t in parts if l == level]) >= FAN:  # noqa: E741
            token = uuid.uuid4().hex
            self.write(self.merged(self.parts(same)), token)
            made.append(token)
            parts, gone, level = [p for p in parts if p[0] != level] + [[level + 1, token]], gone + same, level + 1

        def step(rows: dict) -> bool:
            if (rows.get(self.name) or NEW)["mark"] != row["mark"]:
                return False
            rows[self.name] = {"mark": last, "parts": parts, "retired": gone or row["retired"], "totals": totals}
            return True

        won = self.log.store.change(TABLE, step)
        for t in (row["retired"] if gone else []) if won else made:
            fs, path = self.log._fs(f"{self.folder}/{t}")
            fs.delete(path, True)
        return last - row["mark"] if won else 0


class PositionIndex(Follower):
    """The log's events once more, ordered by source, bucket of the key's hash and position, with a zone map: for each file and bucket its first and last position.

    A consumer group of n partitions needs the buckets that are its partition's number modulo gcd(n, buckets), so `buckets` should have many divisors; any n is answered
    exactly. Files hold at most `rows_a_file` rows. Ids and payload hashes, the longest part of an event, follow from its other columns, so polls compute them for the rows they return.
    """

    def __init__(self, log: EventLog, folder: str, name: str = "positions", buckets: int = 48, rows_a_file: int = 1_000_000) -> None:
        super().__init__(log, folder, name)
        self.buckets, self.rows_a_file = buckets, rows_a_file

    def prepared(self, events: DataFrame) -> DataFrame:
        return events.drop("batch", "id", "payload_hash").withColumn("bucket", F.pmod("key_hash", F.lit(self.buckets)).cast("int"))

    def write(self, rows: DataFrame, part: str) -> None:
        order = ["source_id", "bucket", *POSITION]
        path = f"{self.folder}/{part}/data"
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", self.rows_a_file).option("compression", "zstd").parquet(path)
        at = F.struct(*POSITION)
        zones = self.spark.read.parquet(path).groupBy("source_id", "bucket", F.col("_metadata.file_path").alias("file")).agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count(F.lit(1)).alias("n"))
        flat = zones.select("source_id", "bucket", "file", "n", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("low", "high") for c in POSITION])
        keys = ["source_id", "bucket", "low_commit_end_lsn"]
        flat.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{self.folder}/{part}/zones")

    def poll(self, source_id: str, partitions: int, partition: int, lsn: int | None, seq: int | None, most: int) -> DataFrame:
        """The same rows as events.poll() over the whole log, from the few files that hold them.

        Files are taken in the order of their first positions. What lies before the first position of those not taken is certain; if that is fewer than `most` rows, twice
        as many files are taken. Batches that the index has not taken in yet are read beside it.
        """
        row = self.row()
        number = self.log.row()["number"]
        mine = (F.col("source_id") == source_id) & after(lsn, seq) & (partition_of("key_hash", partitions) == partition)
        tail = self.log.read((row["mark"] + 1, number)).drop("batch").filter(mine) if number > row["mark"] else None
        if not row["parts"]:
            rows = self.log.read().filter(mine) if tail is None else tail
            return rows.orderBy(*POSITION).limit(most)
        tokens = [t for _, t in row["parts"]]
        common = math.gcd(self.buckets, partitions) if partitions > 0 else 1
        behind = F.lit(True) if lsn is None else (F.col("high_commit_end_lsn") >= lsn) & ((F.col("high_commit_end_lsn") > lsn) | (F.col("high_sequence_number") > (seq or 0)))
        bucket = (F.pmod("bucket", F.lit(common)) == partition % common) & (F.lit(partitions > 0) | F.lit(partition == 0))
        zones = self.parts(tokens, "zones").filter((F.col("source_id") == source_id) & bucket & behind).orderBy("low_commit_end_lsn", "low_sequence_number", "file", "bucket")
        columns, take = None, 0
        while True:
            wanted = max(2 * take, 32)
            near = zones.limit(wanted + 1).collect()  # zones only, as many as are about to be read
            if not take:  # at first the zones that should hold enough, by their rows and the partition's share of its buckets
                need, take = most * max(partitions, 1) // common, 1
                while take < min(wanted, len(near)) and sum(z["n"] for z in near[:take]) < need:
                    take += 1
            else:
                take *= 2
            beyond = near[take] if len(near) > take else None
            files = sorted({z["file"] for z in near[:take]})
            found = self.spark.read.parquet(*files).filter(mine & F.col("bucket").isin(sorted({z["bucket"] for z in near[:take]}))).drop("bucket").withColumns({"id": event_id(), "payload_hash": payload_hash()}) if files else None
            if found is None:
                found = tail if tail is not None else self.log.read().filter(F.lit(False))
            elif tail is not None:
                found = found.unionByName(tail.select(*found.columns))
            if beyond is None:
                return found.orderBy(*POSITION).limit(most)
            before = (F.col("commit_end_lsn") < beyond["low_commit_end_lsn"]) | ((F.col("commit_end_lsn") == beyond["low_commit_end_lsn"]) & (F.col("sequence_number") < beyond["low_sequence_number"]))
            certain = found.filter(before)
            if certain.limit(most).count() >= most:
                return certain.orderBy(*POSITION).limit(most)


class RunningStatistics(Follower):
    """events.statistics() without a scan of the events: how many there are of each source and commit time, and each source's count and newest time in the control store.

    A look reads the counts of one minute, by the statistics of row groups ordered by time.
    """

    def __init__(self, log: EventLog, folder: str, name: str = "statistics") -> None:
        super().__init__(log, folder, name)

    def prepared(self, events: DataFrame) -> DataFrame:
        return events.groupBy("source_id", F.unix_micros(F.col("commit_timestamp").cast("timestamp")).alias("at")).agg(F.count(F.lit(1)).alias("n"))

    def merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("source_id", "at").agg(F.sum("n").alias("n"))

    def write(self, rows: DataFrame, part: str) -> None:
        rows.repartitionByRange("at", "source_id").sortWithinPartitions("at", "source_id").write.parquet(f"{self.folder}/{part}/data")

    def totals(self, part: str, before: dict) -> dict:
        new = self.parts([part]).groupBy("source_id").agg(F.sum("n").alias("n"), F.max("at").alias("at")).collect()  # a row for each source
        return before | {r["source_id"]: [before.get(r["source_id"], [0])[0] + r["n"], max((x for x in (before.get(r["source_id"], [0, None])[1], r["at"]) if x is not None), default=None)] for r in new}

    def look(self, as_of: str, by_source: bool = False) -> DataFrame:
        """Events, events a second over the minute before as_of, and the age of the newest event, as seconds and as text; for each source that has events, if wanted."""
        row = self.row()
        t = F.unix_micros(F.lit(as_of).cast("timestamp"))
        known = self.spark.createDataFrame([(s, n, at) for s, (n, at) in row["totals"].items()], "source_id string, total long, newest long")
        recent = self.spark.createDataFrame([], "source_id string, at long, n long")
        if row["parts"]:
            recent = self.parts([p for _, p in row["parts"]]).filter((F.col("at") > t - 60_000_000) & (F.col("at") <= t))
        counted = known.join(F.broadcast(recent.groupBy("source_id").agg(F.sum("n").alias("recent"))), "source_id", "left")  # a row for each source
        groups = ["source_id"] if by_source else []
        sums: list[Column] = [F.coalesce(F.sum("total"), F.lit(0)).alias("events"), (F.coalesce(F.sum("recent"), F.lit(0)) / 60.0).alias("events_per_second"), ((t - F.max("newest")) / 1e6).alias("lag_seconds")]
        return counted.groupBy(*groups).agg(*sums).withColumn("lag_text", lag_text())
