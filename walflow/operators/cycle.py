"""The delivery cycle: enqueue what is new in the event log, send what is due, record it, plan the next tries.

Enqueueing reads only batches of the log behind each sink's mark, the last position up to which its matches are queued; a new sink has none and gets all. Waiting
attempts are dealt to slots by sink and event, and each slot has a queue of its own and a lease of its own, so several workers share the slots. A worker reads the queues of
the slots it holds, never the history: of what is due it takes each sink's oldest first and all sinks in turn, so that no sink keeps others waiting.
Attempts of a removed sink end as permanent failures; those of a disabled sink wait; a sink whose circuit is open is passed over.

Everything that a step changes becomes visible by one compare and set of its row in the control store: the rows of marks and queues hold the names of the folders that count. What was
sent is stored under the slot and the version of its queue before anything is recorded, and looked up there first, so a worker that dies between sending and recording makes nobody send again.

Queues and what was sent are tables of narrow rows, and each step reads them there; none is kept in the executors' memory, which without a limit on what is enqueued and sent would not hold them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from walflow.functions.exprs import idempotency_key
from walflow.functions.session import shuffles_dropped
from walflow.operators.control import ControlStore, Fenced
from walflow.operators.delivery import SINKS_BROADCAST, Transport, circuit_counts, dead_letters, fan_out, next_attempts, sent, settled
from walflow.operators.ingest import NATURAL_KEY
from walflow.operators.publish import EventLog

SLOTS, SHARE = 8, 4
SLOT_PARTS = 16  # tasks that write a slot's queue
ENQUEUED, SENT = 500, 10
SEND_SECONDS = 30
ALL_SECONDS = 24 * 3600
DRIVER_ROWS = 10_000  # a place further down an order is not looked up in the driver
QUEUE = "slot int, sink_id string, event_id binary, batch int, commit_end_lsn long, sequence_number int, source_id string, attempt_number int, status string, next_retry_at timestamp"
DONE = QUEUE + ", http_status int, error string, finished_at timestamp"
_SENT = ["schema_name", "table_name", "operation", "before", "after", "key_columns"]  # of an event, besides what its queue's row has
PLACE = ["batch", "commit_end_lsn", "sequence_number", "source_id"]
_END = 2**63 - 1
_cols = lambda schema: [c.strip().split(" ")[0] for c in schema.split(",")]


def _place_of(places: DataFrame, n: int) -> list[Row]:
    """The n-th smallest place, as a list; empty if there are fewer. Far down the order, places are sorted in ranges; the driver sees how many are in each, and the one row."""
    if n <= DRIVER_ROWS:
        return places.orderBy(*PLACE).offset(n - 1).head(1)
    ranged = places.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).withColumn("_row", F.monotonically_increasing_id()).persist()
    try:
        part = F.shiftright("_row", 33)
        for r in ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
            if n <= r["n"]:
                return ranged.filter(F.col("_row") == (r["part"] << 33) + n - 1).select(*PLACE).head(1)
            n -= r["n"]
        return []
    finally:
        ranged.unpersist()


class Deliveries:
    """Attempts for the events of a log, under a folder."""

    def __init__(self, spark: SparkSession, folder: str, store: ControlStore, log: EventLog, slots: int = SLOTS, enqueued: int | None = ENQUEUED, most: int | None = SENT) -> None:
        """enqueued, most: see enqueue() and tick(); None for all there is."""
        self.spark, self.folder, self.store, self.log, self.slots, self.enqueued, self.most = spark, folder.rstrip("/"), store, log, slots, enqueued, most
        self.seconds = SEND_SECONDS * most + 60 if most else ALL_SECONDS  # longer than all of a slot's sends can take one after another

    # rows with an owner

    def _row(self, table: str) -> dict:
        return self.store.read(f"delivery_{table}")[1].get("row") or {"owner": "", "expires": 0, "version": 0, "staged": None}

    def _claim(self, table: str, owner: str) -> dict | None:
        """The row as it is now, claimed for owner; None while another's claim lives."""

        def step(rows: dict) -> dict | None:
            have = rows.get("row") or self._row("-")
            if have["owner"] not in ("", owner) and have["expires"] > self.store.clock():
                return None
            rows["row"] = have | {"owner": owner, "expires": self.store.clock() + self.seconds}
            return rows["row"]

        return self.store.change(f"delivery_{table}", step)

    def _set(self, table: str, owner: str, before: dict, **new: object) -> None:
        """The row's next version, and free for others; Fenced if it has another owner or version by now."""

        def step(rows: dict) -> None:
            have = rows.get("row") or {}
            if have.get("owner") != owner or have.get("version") != before["version"]:
                raise Fenced(table)
            rows["row"] = have | new | {"owner": "", "expires": 0, "version": before["version"] + bool(new)}

        self.store.change(f"delivery_{table}", step)

    # folders

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _move(self, staged: str | None, to: str) -> None:
        """Gives a staged folder its place, if its writer could not."""
        if staged and self._exists(f"{self.folder}/_staged/{staged}"):
            fs, p = self._fs(f"{self.folder}/_staged/{staged}")
            fs.mkdirs(self._fs(to)[1].getParent())
            fs.rename(p, self._fs(to)[1])

    def _read(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    # enqueue

    def _behind(self, marks: dict[str, list], number: int, sinks: list[str]) -> DataFrame | None:
        """The log's events with the sinks that have not got that far; None if all have. Each sink's part begins in the batch of its mark."""
        by_mark: dict[tuple, list[str]] = {}
        for s in sinks:
            mark = tuple(marks.get(s) or (0, _END, 0, ""))
            if mark < (number, _END):
                by_mark.setdefault(mark, []).append(s)
        if not by_mark:
            return None
        events = self.log.read(batches=(min(m[0] + (m[1] == _END) for m in by_mark), number))
        at = F.struct(*PLACE)
        sets = [F.when(at > F.struct(*[F.lit(v).cast(events.schema[c].dataType) for c, v in zip(PLACE, m, strict=True)]), F.array(*map(F.lit, s))).otherwise(F.array().cast("array<string>")) for m, s in by_mark.items()]
        return events.withColumn("_for", reduce(F.array_union, sets)).filter(F.size("_for") > 0)

    def enqueue(self, sinks: DataFrame, owner: str) -> int:
        """Queues the oldest matches behind the sinks' marks: at least `enqueued`, if there are as many, and all of the last position."""
        row = self._claim("marks", owner)
        if row is None:
            return 0
        self._move(row["staged"], f"{self.folder}/new/number={row['version']}")
        marks, number = row.get("marks", {}), self.log.row()["number"]
        on = [r[0] for r in sinks.filter("enabled").select("sink_id").collect()]  # the registry's rows
        events = self._behind(marks, number, on)
        if events is None:
            self._set("marks", owner, row)
            return 0
        found = fan_out(events, sinks).filter(F.array_contains("_for", F.col("sink_id")))
        last = _place_of(found.select(*PLACE), self.enqueued) if self.enqueued else []
        if last:
            found = found.filter(F.struct(*PLACE) <= F.struct(*[F.lit(v).cast(found.schema[c].dataType) for c, v in zip(PLACE, last[0], strict=True)]))
        mark = list(last[0]) if last else [number, _END, 0, ""]
        slot = F.pmod(F.xxhash64("sink_id", "id"), F.lit(self.slots)).cast("int").alias("slot")
        rows = found.select(slot, "sink_id", F.col("id").alias("event_id"), *PLACE, F.lit(1).alias("attempt_number"), F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("next_retry_at"))
        token = f"new-{uuid.uuid4().hex}"
        with shuffles_dropped(self.spark):
            rows.write.partitionBy("slot").parquet(f"{self.folder}/_staged/{token}")
        ahead = {s: (marks[s] if s in marks and tuple(marks[s]) > tuple(mark) else mark) for s in on}
        self._set("marks", owner, row, marks={s: m for s, m in marks.items() if s not in ahead and s in self._names(sinks)} | ahead, staged=token)
        self._move(token, f"{self.folder}/new/number={row['version'] + 1}")
        return 1

    @staticmethod
    def _names(sinks: DataFrame) -> set[str]:
        return {r[0] for r in sinks.select("sink_id").collect()}

    # queues

    def _queued(self, rows: dict[int, dict]) -> DataFrame:
        """The waiting attempts of slots: their queues, and what was enqueued after these were written."""
        parts = [self._read(f"{self.folder}/queues/{r['queue']}", QUEUE).filter(F.col("slot") == k) for k, r in rows.items() if r.get("queue")]
        newest = self._row("marks")
        self._move(newest["staged"], f"{self.folder}/new/number={newest['version']}")
        low = min(r.get("consumed", 0) for r in rows.values())
        paths = [p for n in range(low + 1, newest["version"] + 1) if self._exists(p := f"{self.folder}/new/number={n}")]
        if paths:
            consumed = F.element_at(F.create_map(*[F.lit(x) for k, r in rows.items() for x in (k, r.get("consumed", 0))]), F.col("slot"))
            new = self.spark.read.schema(QUEUE + ", number int").option("basePath", f"{self.folder}/new").parquet(*paths)
            parts.append(new.filter(F.col("slot").isin(list(rows))).filter(F.col("number") > consumed).drop("number").select(*_cols(QUEUE)))
        for r in rows.values():
            r["seen"] = newest["version"]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], QUEUE)

    def _circuits(self, sinks: DataFrame, as_of: float, owner: str) -> tuple[list[str], list[str]]:
        """Sinks that get nothing now, and sinks that get one trial by this worker."""
        limits = {r[0]: (r[1], r[2]) for r in sinks.filter("circuit_failures > 0").select("sink_id", "circuit_failures", "circuit_pause_ms").collect()} if "circuit_failures" in sinks.columns else {}

        def step(rows: dict) -> tuple[list[str], list[str]]:
            shut, trial = [], []
            for s, (most, pause) in limits.items():
                r = rows.get(s)
                if not r or r["streak"] < most:
                    continue
                if as_of < r["last"] + pause / 1000 or (r.get("trial_by") not in (None, owner) and r["trial_until"] > self.store.clock()):
                    shut.append(s)
                else:
                    rows[s] = r | {"trial_by": owner, "trial_until": self.store.clock() + self.seconds}
                    trial.append(s)
            return shut, trial

        return self.store.change("delivery_circuits", step) if limits else ([], [])

    def _counted(self, results: DataFrame, as_of: float) -> None:
        """Failures in a row of each sink after these results."""
        found = circuit_counts(results, PLACE).collect()  # a row a sink

        def step(rows: dict) -> None:
            for r in found:
                before = rows.get(r["sink_id"], {"streak": 0})["streak"]
                rows[r["sink_id"]] = {"streak": r["failures"] + (0 if r["succeeded"] else before), "last": as_of}

        if found:
            self.store.change("delivery_circuits", step)

    def _serve(self, rows: dict[int, dict], sinks: DataFrame, transport: Transport, as_of: str, owner: str, tried: set[str]) -> int:
        at = self.spark.range(1).select(F.unix_timestamp(F.lit(as_of).cast("timestamp"))).first()[0]
        now = F.timestamp_seconds(F.lit(at))
        queue = self._queued(rows)
        if not queue.head(1):
            for k, r in rows.items():
                self._set(f"slot_{k}", owner, r)
            return 0
        shut, trial = self._circuits(sinks, at, owner)
        shut, tried_now = shut + [s for s in trial if s in tried], [s for s in trial if s not in tried]
        of = sinks.select("sink_id", "url", "secret", "max_attempts", "retry_initial_ms", "retry_max_ms", "enabled")
        few = sinks.limit(SINKS_BROADCAST + 1).count() <= SINKS_BROADCAST
        known = queue.join(F.broadcast(of) if few else of, "sink_id", "left")
        ready = known.filter(F.col("enabled") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)) & ~F.col("sink_id").isin(shut))
        turn = F.row_number().over(Window.partitionBy("slot", "sink_id").orderBy(*PLACE, "attempt_number"))
        first = F.row_number().over(Window.partitionBy("sink_id").orderBy(*PLACE, "attempt_number"))
        if tried_now:
            ready = ready.withColumn("first", first).filter(~F.col("sink_id").isin(tried_now) | (F.col("first") == 1)).drop("first")
        place = F.row_number().over(Window.partitionBy("slot").orderBy("turn", *PLACE, "sink_id"))
        due = ready.withColumn("turn", turn).withColumn("place", place).filter(F.col("place") <= self.most).drop("turn", "place") if self.most else ready
        have = {k: f"{self.folder}/sent/slot={k}/version={r['version']}" for k, r in rows.items()}
        to_send = [k for k in rows if not self._exists(have[k])]
        tried.update(tried_now)
        n = self._send(due.filter(F.col("slot").isin(to_send)), {k: rows[k]["version"] for k in to_send}, transport, at) if to_send else 0
        return n + self._record(queue, known, rows, [have[k] for k in rows if self._exists(have[k])], as_of, now, at, owner)

    def _send(self, due: DataFrame, versions: dict[int, int], transport: Transport, at: int) -> int:
        due = due.persist() if self.most else due  # at most `most` a slot; without that limit it is what the queues' tables hold
        try:
            batches = [r[0] for r in due.select("batch").distinct().collect()]  # a row a batch of the log
            if not batches:
                return 0
            events = self.log.read(batches=(min(batches), max(batches))).filter(F.col("batch").isin(batches)).select(*NATURAL_KEY, *_SENT)
            same = [F.col(f"d.{c}").eqNullSafe(F.col(f"e.{c}")) if c == "source_id" else F.col(f"d.{c}") == F.col(f"e.{c}") for c in NATURAL_KEY]
            work = due.alias("d").join(events.alias("e"), same).select("d.*", *_SENT, F.col("event_id").alias("id"), idempotency_key("sink_id", "event_id").alias("idempotency_key"))
            version = F.element_at(F.create_map(*[F.lit(x) for k, v in versions.items() for x in (k, v)]), F.col("slot")).alias("version")
            keep = ["slot", "sink_id", "event_id", "batch", *PLACE[1:], "attempt_number", "max_attempts", "retry_initial_ms", "retry_max_ms"]
            seen = Observation()
            came = sent(work, transport, at, keep).select("*", version).observe(seen, F.count(F.lit(1)).alias("n"))
            with shuffles_dropped(self.spark):
                came.write.mode("append").partitionBy("slot", "version").parquet(f"{self.folder}/sent")
            return seen.get["n"]
        finally:
            if self.most:
                due.unpersist()

    def _record(self, queue: DataFrame, known: DataFrame, rows: dict[int, dict], paths: list[str], as_of: str, now: Column, at: int, owner: str) -> int:
        """Moves what is finished out of the queues, and puts next attempts in; all of a slot becomes visible with its row."""
        done = known.filter("url is null and enabled is null").select(*_cols(QUEUE)).withColumns({"status": F.lit("permanent_failure"), "http_status": F.lit(None).cast("int"), "error": F.lit("sink removed"), "finished_at": now})
        again = self.spark.createDataFrame([], QUEUE)
        if paths:
            results = settled(self.spark.read.option("basePath", f"{self.folder}/sent").parquet(*paths))
            self._counted(results, at)
            done = done.unionByName(results.withColumn("finished_at", now).withColumn("next_retry_at", F.lit(None).cast("timestamp")).select(*_cols(DONE)))
            again = next_attempts(results, as_of, ["slot", *PLACE]).select(*_cols(QUEUE))
        if not paths and not done.head(1) and all(r["seen"] == r.get("consumed", 0) for r in rows.values()):
            for k, r in rows.items():
                self._set(f"slot_{k}", owner, r)
            return 0
        key = ["sink_id", "event_id", "attempt_number"]
        left = queue.join(done.select(*key), key, "left_anti").select(*_cols(QUEUE)).unionByName(again)
        token = uuid.uuid4().hex
        with shuffles_dropped(self.spark):
            left.repartition("slot", F.pmod(F.xxhash64("event_id"), F.lit(SLOT_PARTS))).write.partitionBy("slot").parquet(f"{self.folder}/queues/{token}")
            done.write.partitionBy("slot").parquet(f"{self.folder}/_staged/done-{token}")
        for k, r in rows.items():
            try:
                self._set(f"slot_{k}", owner, r, queue=token, staged=f"done-{token}/slot={k}", consumed=r["seen"])
                self._move(f"done-{token}/slot={k}", f"{self.folder}/done/slot={k}/version={r['version'] + 1}")
            except Fenced:
                continue  # another worker has the slot, and finds there what was sent
        return 0

    def tick(self, sinks: DataFrame, transport: Transport, as_of: str, owner: str = "worker", share: int = SHARE) -> int:
        """One round at a time as_of (UTC): returns how many attempts were sent. sinks: see fan_out(), with url, secret, max_attempts and delays.

        The slots are served `share` at a time, those that another worker holds are left to it.
        """
        self.enqueue(sinks, owner)
        n, tried = 0, set()
        for a in range(0, self.slots, share):
            rows = {k: r for k in range(a, min(a + share, self.slots)) if (r := self._claim(f"slot_{k}", owner)) is not None}
            for k, r in rows.items():
                self._move(r["staged"], f"{self.folder}/done/slot={k}/version={r['version']}")
            if rows:
                n += self._serve(rows, sinks, transport, as_of, owner, tried)
        return n

    # reading

    def attempts(self) -> DataFrame:
        """Every attempt in its latest state, finished ones and those that wait."""
        rows = {k: self._row(f"slot_{k}") for k in range(self.slots)}
        for k, r in rows.items():
            self._move(r["staged"], f"{self.folder}/done/slot={k}/version={r['version']}")
        waiting = self._queued(rows).withColumns({"http_status": F.lit(None).cast("int"), "error": F.lit(None).cast("string"), "finished_at": F.lit(None).cast("timestamp")})
        return self._read(f"{self.folder}/done", DONE + ", version int").drop("version").select(*_cols(DONE)).unionByName(waiting.select(*_cols(DONE)))

    def dead_letters(self) -> DataFrame:
        return dead_letters(self.attempts())
