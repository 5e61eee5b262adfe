"""Replay sessions: a bounded range of stored events sent to files, a consumer group's offset, or a sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from walflow.functions.exprs import format_lsn, outcome, partition_of
from walflow.operators.consumer import ConsumerGroup
from walflow.operators.control import ControlStore, Fenced, Leases
from walflow.operators.delivery import Transport, body, http_transport
from walflow.operators.delivery import sent as posted
from walflow.operators.events import replay_range


SLICE = 100_000  # events
WAVE = 16  # slices that are sent together, a task each


class Replays:
    """Sessions and their states: pending, running, completed, cancelled, failed."""

    def __init__(self, store: ControlStore) -> None:
        self.store, self.leases = store, Leases(store, "replay-leases", 600)

    def create(self, name: str, **session: object) -> None:
        """start, end, source_id, schema_filter, table_filter, operation_filter; destination jsonl (path), webhook (sink, and path for the results), consumer (group, see seek()), or callback. ValueError if the name is taken."""

        def step(s: dict) -> None:
            if name in s:
                raise ValueError(f"{name} exists")
            s[name] = dict(session) | {"status": "pending", "created_at": self.store.clock(), "last_lsn": None, "events_processed": 0}

        self.store.change("replays", step)

    def get(self, name: str) -> dict:
        return self.store.read("replays")[1][name]

    def list(self, source_id: str | None = None) -> list[dict]:
        """Newest first; of one source, if it is given."""
        return sorted(({"name": k} | v for k, v in self.store.read("replays")[1].items() if source_id in (None, v.get("source_id"))), key=lambda r: (-r["created_at"], r["name"]))

    def _move(self, name: str, before: tuple[str, ...], **change: object) -> bool:
        def step(s: dict) -> bool:
            if s[name]["status"] not in before:
                return False
            s[name] |= change
            return True

        return self.store.change("replays", step)

    def cancel(self, name: str) -> bool:
        return self._move(name, ("pending", "running", "paused"), status="cancelled")

    def seek(self, name: str, events: DataFrame, group: ConsumerGroup, member: str) -> int:
        """Runs a session whose destination is a group: its partitions go back to just before the first event of the range. Returns how many were moved.

        Partitions that another member holds are left alone, and the session then fails; it may be run again, as may one that was broken off. It runs under a lease,
        so a second caller gets Fenced while the first one works.
        """
        lease = self.leases.claim(name, member)
        if lease is None:
            raise Fenced(f"{name} is being run")
        try:
            return self._seek(name, events, group, member)
        finally:
            self.leases.release(name, member, lease)

    def _seek(self, name: str, events: DataFrame, group: ConsumerGroup, member: str) -> int:
        s = self.get(name)
        rows = replay_range(events, s.get("start"), s.get("end"), s.get("schema_filter"), s.get("table_filter"), s.get("operation_filter"), group.source_id)
        place = partition_of("key_hash", group.partitions).alias("partition")
        firsts = rows.groupBy(place).agg(F.min(F.struct("commit_end_lsn", "sequence_number")).alias("at")).collect()  # a row a partition
        if not self._move(name, ("pending", "running", "failed"), status="running"):
            raise ValueError(f"{name} is {self.get(name)['status']}")
        held = {r["partition"]: group.leases.claim(f"lease/{r['partition']}", member) for r in firsts}
        for r in firsts:
            if (g := held[r["partition"]]) is not None:
                group.seek(r["partition"], member, g, r["at"]["commit_end_lsn"], r["at"]["sequence_number"] - 1)
                group.leases.release(f"lease/{r['partition']}", member, g)
        self._move(name, ("running",), status="failed" if None in held.values() else "completed")
        return sum(g is not None for g in held.values())

    def run(self, name: str, events: DataFrame, send: Callable[[DataFrame], None] | None = None, owner: str | None = None, sinks: DataFrame | None = None, transport: Transport = http_transport) -> int:
        """Runs a pending session, or goes on with one that was broken off. Returns the number of events sent by this call.

        A session runs under a lease, so a second caller gets Fenced while the first one works.

        Events go source by source, in slices of whole positions of about SLICE events, WAVE of them at once, and each event's row is read once; after each wave its
        source's position is stored in `sent`, and a later run starts behind it. The wave that was broken off is sent again. A webhook's results are kept at the
        session's path (event_id, http_status, error, status, ...) and the events that it did not take are counted in `failed`; receivers tell a repeated one by its idempotency key.
        """
        owner = owner or uuid.uuid4().hex
        generation = self.leases.claim(name, owner)
        if generation is None:
            raise Fenced(f"{name} is being run")
        if not self._move(name, ("pending", "running", "failed"), status="running"):
            self.leases.release(name, owner, generation)
            raise ValueError(f"{name} is {self.get(name)['status']}")
        s, total = self.get(name), 0
        rows = replay_range(events, s.get("start"), s.get("end"), s.get("schema_filter"), s.get("table_filter"), s.get("operation_filter"), s.get("source_id"))
        for source, lsn in s.get("sent", {}).items():
            rows = rows.filter((F.col("source_id") != source) | (F.col("commit_end_lsn") > lsn))
        try:
            if send is None and s.get("destination") not in ("jsonl", "webhook"):
                raise ValueError("a destination is needed")
            for source, low, ends in self._waves(rows, 1 if send is not None else WAVE):
                part = rows.filter((F.col("source_id") == source) & (F.col("commit_end_lsn") <= ends[-1]) & (F.lit(low is None) | (F.col("commit_end_lsn") > low)))
                if not self.leases.heartbeat(name, owner, generation):
                    raise Fenced(f"{name} was taken over")
                failed = 0
                if send is not None:
                    send(part)
                    n = part.count()
                else:
                    n, failed = self._sent(name, s, part, ends, sinks, transport)
                total += n
                now = self.get(name)
                after = {"sent": now.get("sent", {}) | {source: ends[-1]}, "last_lsn": max(ends[-1], now["last_lsn"] or ends[-1])}
                if not self._move(name, ("running",), **after, events_processed=now["events_processed"] + n, failed=now.get("failed", 0) + failed):
                    return total  # cancelled
        except Exception as e:
            self._move(name, ("running",), status="failed", error=str(e)[:500])
            raise
        finally:
            self.leases.release(name, owner, generation)
        self._move(name, ("running",), status="completed")
        return total

    def _sent(self, name: str, session: dict, part: DataFrame, ends: list[int], sinks: DataFrame | None, transport: Transport) -> tuple[int, int]:
        """Writes or posts the slices of a wave, a task each and in order within; returns how many events there were, and how many a webhook did not take."""
        of = reduce(lambda c, i: F.when(F.col("commit_end_lsn") <= ends[i], i).otherwise(c), range(len(ends) - 1, -1, -1), F.lit(len(ends)))
        placed = part.withColumn("_slice", of).repartition(len(ends), "_slice").sortWithinPartitions("_slice", "commit_end_lsn", "sequence_number")
        seen = Observation()
        if session["destination"] == "jsonl":
            placed.observe(seen, F.count(F.lit(1)).alias("n")).select(body().alias("value")).write.mode("append").text(session["path"])
            return seen.get["n"], 0
        sink = sinks.filter(F.col("sink_id") == session["sink"]).select("url", "secret").head(1) if sinks is not None else None
        if not sink:
            raise ValueError(f"no sink {session.get('sink')}")
        at = int(self.store.clock())
        work = placed.withColumns({"url": F.lit(sink[0]["url"]), "secret": F.lit(sink[0]["secret"]), "attempt_number": F.lit(1), "idempotency_key": F.concat_ws(":", F.lit(f"replay-{name}"), F.lower(F.hex("id")))})
        results = posted(work, transport, at, ["id", "source_id", "commit_end_lsn", "sequence_number"]).withColumnRenamed("id", "event_id").withColumn("status", outcome("http_status", F.lit(1), F.lit(1)))
        counts = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "success").alias("failed")]
        results.observe(seen, *counts).write.mode("append").parquet(session["path"])
        return seen.get["n"], seen.get["failed"]

    def _waves(self, rows: DataFrame, most: int) -> list[tuple[str, int | None, list[int]]]:
        """source_id, position before, and the last positions of up to `most` slices in a row of that source."""
        out: list[tuple[str, int | None, list[int]]] = []
        for source, low, high in self._slices(rows):
            if out and out[-1][0] == source and len(out[-1][2]) < most:
                out[-1][2].append(high)
            else:
                out.append((source, low, [high]))
        return out

    def _slices(self, rows: DataFrame) -> list[tuple[str, int | None, int]]:
        """source_id, position before and last position of each slice, in order."""
        held = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max("commit_end_lsn").alias("end")).orderBy("source_id").collect()  # a row a source
        out = []
        for r in held:
            k = -(-r["n"] // SLICE)
            shares = [i / k for i in range(1, k)]
            cuts = rows.filter(F.col("source_id") == r["source_id"]).agg(F.percentile_approx("commit_end_lsn", shares, 10 * k)).first()[0] if shares else []
            ends = sorted({*cuts, r["end"]})
            out += [(r["source_id"], low, high) for low, high in zip([None, *ends], ends)]
        return out


def as_text(events: DataFrame) -> DataFrame:
    """Events as lines for people: position, table, operation, key."""
    return events.select(F.concat_ws(" ", format_lsn("commit_end_lsn"), F.col("sequence_number").cast("string"), F.concat_ws(".", "schema_name", "table_name"), "operation", F.to_json("key_columns")).alias("line"))
