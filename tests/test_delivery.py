"""The delivery cycle: marks instead of scans, workers that share slots, sinks that come late, are removed, disabled or failing, and workers that die."""

import pytest
from pyspark.sql import functions as F

from walflow.operators import delivery
from walflow.operators.control import ControlStore
from walflow.operators.cycle import Deliveries
from walflow.operators.ingest import stored
from walflow.operators.publish import EventLog
from walflow.operators.registry import Registry
from walflow.sources.commerce import order_changes

SF = "/root/testdata/sf0.001"


class World:
    def __init__(self, spark, path, upto=10 * 1024, **given):
        self.now, self.spark, self.path = 0.0, spark, path
        self.store = ControlStore(spark, f"file://{path}/control", clock=lambda: self.now)
        self.log, self.events = EventLog(spark, f"file://{path}/events", self.store, seconds=1e9), order_changes(spark, SF)
        self.generation, self.batch = self.log.claim("capture"), -1
        self.upto = 0
        self.publish(upto)
        self.registry = Registry(self.store, {"k1": b"1" * 32}, "k1")
        self.work = self.worker(**given)

    def worker(self, **given):
        return Deliveries(self.spark, f"file://{self.path}/deliveries", self.store, self.log, **({"slots": 2, "enqueued": 500, "most": 500} | given))

    def publish(self, upto):
        self.batch += 1
        self.log.publish(self.events.filter(F.col("commit_end_lsn").between(self.upto + 1, upto)), {"orders": upto}, {}, "q", self.batch, "capture", self.generation)
        self.upto = upto

    def sink(self, name, **row):
        self.registry.add("sinks", name, url=name, secret="k", **({"retry_initial_ms": 1000, "retry_max_ms": 1000, "max_attempts": 2} | row))

    def tick(self, answer=lambda url, body: 200, at=0, owner="w", work=None, share=2):
        log = f"{self.path}/sent.log"

        def transport(url, headers, payload):
            with open(log, "a") as f:
                f.write(f"{url} {headers['X-Event-Id']} {headers['X-Attempt']}\n")
            return answer(url, payload), "", None, False

        return (work or self.work).tick(self.registry.sinks(), transport, f"2024-01-01 00:{at:02d}:00", owner, share)

    def sent(self):
        try:
            with open(f"{self.path}/sent.log") as f:
                return f.read().split("\n")[:-1]
        except FileNotFoundError:
            return []

    def states(self):
        return {(r["sink_id"], r["status"]): r["n"] for r in self.work.attempts().groupBy("sink_id", "status").agg(F.count(F.lit(1)).alias("n")).collect()}

    def matches(self):
        return delivery.fan_out(stored(self.log.read()), self.registry.sinks()).count()


def test_enqueue_behind_marks(spark, tmp_path, monkeypatch):
    w = World(spark, tmp_path, enqueued=20)
    w.sink("a")
    w.sink("b", table_filter="orders")
    while w.tick():
        pass
    n = w.matches()
    assert len(w.sent()) == len(set(w.sent())) == n == sum(w.states().values()) > 40
    none = delivery.pending(stored(w.log.read()), w.registry.sinks(), w.work.attempts())
    assert none.count() == 0, "as many as the full anti join finds"
    reads = []
    monkeypatch.setattr(w.log, "read", lambda *a, **k: reads.append(1) or EventLog.read(w.log, *a, **k))
    assert w.tick() == 0 and not reads, "nothing is read of a log that has not grown"
    w.sink("late", operation_filter="delete, update")
    while w.tick():
        pass
    w.publish(13 * 1024)
    batches = []
    monkeypatch.setattr(w.log, "read", lambda batches_=None, **k: batches.append(k.get("batches")) or EventLog.read(w.log, **k))
    while w.tick():
        pass
    assert {b[0] for b in batches} == {2}, "only the new batch is read"
    monkeypatch.undo()
    assert len(w.sent()) == len(set(w.sent())) == w.matches() and w.states()["late", "success"] == w.log.read().filter("operation <> 'insert'").count()


def test_sinks_that_block_nobody(spark, tmp_path):
    w = World(spark, tmp_path, most=3)
    w.sink("gone")
    w.sink("off")
    w.sink("on")
    sinks = w.registry.sinks()
    w.work.enqueue(sinks, "w")
    n = w.log.read().count()
    w.registry.update("sinks", "off", enabled=False)
    w.registry.sinks = lambda keep=w.registry.sinks: keep().filter("sink_id <> 'gone'")
    sends = [w.tick() for _ in range(n)]
    assert sum(sends) == n and max(sends) == 6, "a slot sends `most` a tick"
    assert w.states() == {("gone", "permanent_failure"): n, ("off", "pending"): n, ("on", "success"): n}
    w.registry.update("sinks", "off", enabled=True)
    assert w.tick() == 6


def test_failures_and_dead_letters(spark, tmp_path):
    w = World(spark, tmp_path)
    w.sink("a", max_attempts=3)
    answer = lambda url, body: 500 if '"table_name":"lineitem"' in body else 200
    counts = [w.tick(answer, at) for at in range(6)]
    orders, items = (w.log.read().filter(F.col("table_name") == t).count() for t in ("orders", "lineitem"))
    assert counts == [orders + items, items, items, 0, 0, 0]
    assert w.states() == {("a", "success"): orders, ("a", "retryable"): 2 * items, ("a", "permanent_failure"): items}
    letters = w.work.dead_letters().collect()
    assert len(letters) == items and all([a["attempt"] for a in x["attempt_history"]] == [1, 2, 3] for x in letters)


@pytest.mark.parametrize("point", ["_record", "_set"])
def test_worker_dies_after_sending(spark, tmp_path, monkeypatch, point):
    w = World(spark, tmp_path)
    w.sink("a")
    dying = w.worker()
    w.work.enqueue(w.registry.sinks(), "first")

    def lost(*a, **k):
        raise OSError("lost")

    with monkeypatch.context() as c:
        c.setattr(dying, "enqueue", lambda *a: 0)
        c.setattr(dying, point, lost)
        with pytest.raises(OSError):
            w.tick(owner="first", work=dying)
    n = len(w.sent())
    assert n == w.log.read().count()
    assert w.tick(owner="second", at=3) == 0 and w.states() == {("a", "pending"): n}, "the slots are still the first one's"
    w.now += 1e6
    assert w.tick(owner="second", at=5) == 0 and len(w.sent()) == n and w.states() == {("a", "success"): n}


def test_workers_share(spark, tmp_path):
    w = World(spark, tmp_path)
    w.sink("a")
    w.work.enqueue(w.registry.sinks(), "one")
    other, late = w.worker(), w.worker()
    row = late._claim("slot_1", "one")
    mine = w.tick(owner="two", work=other, share=1)
    theirs = w.log.read().count() - mine
    assert 0 < mine and 0 < theirs and w.states()["a", "pending"] == theirs
    w.now += 1e6
    assert w.tick(owner="two", work=other, share=1) == theirs
    with pytest.raises(Exception):  # noqa: B017
        late._set("slot_1", "one", row, queue="x")
    assert len(w.sent()) == len(set(w.sent())) == w.log.read().count() and set(w.states()) == {("a", "success")}


def test_circuit(spark, tmp_path):
    w = World(spark, tmp_path, most=4, slots=1)
    w.sink("bad", circuit_failures=3, circuit_pause_ms=120_000, max_attempts=50)
    w.sink("good")
    n = w.log.read().count()
    broken = lambda url, body: 500 if url == "bad" else 200
    bad = lambda: sum(s.startswith("bad") for s in w.sent())
    w.tick(broken, 0)
    w.tick(broken, 0)
    first = bad()
    assert 3 <= first <= 4, "no tick but the first sends to it more than once after the limit"
    w.tick(broken, 1)
    assert bad() == first, "open"
    w.tick(broken, 3)
    assert bad() == first + 1, "one trial, which fails"
    w.tick(broken, 4)
    assert bad() == first + 1, "open again"
    for at in range(6, 40):
        w.tick(at=at)
    assert w.states()["good", "success"] == n and w.states()["bad", "success"] > first
    history = w.work.attempts()
    assert [r["state"] for r in delivery.circuit_states(history.filter("sink_id = 'bad' and finished_at <= '2024-01-01 00:03:00'"), 3, 120_000, "2024-01-01 00:04:00").collect()] == ["open"]


def test_place_far_down(spark):
    """A place far down the order is found where the rows are, and is the one that a sort in the driver finds."""
    from walflow.operators import cycle

    k = F.col("id")
    places = spark.range(0, 3000, 1, 5).select((k % 3).cast("int").alias("batch"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("commit_end_lsn"), (k % 7).cast("int").alias("sequence_number"), F.lit("s").alias("source_id"))
    want = sorted(tuple(r) for r in places.collect())
    had, cycle.DRIVER_ROWS = cycle.DRIVER_ROWS, 10
    try:
        assert [tuple(cycle._place_of(places, n)[0]) for n in (1, 11, 1500, 3000)] == [want[n - 1] for n in (1, 11, 1500, 3000)]
        assert cycle._place_of(places, 3001) == []
    finally:
        cycle.DRIVER_ROWS = had
    work = cycle.Deliveries(spark, "unused", None, None, enqueued=None, most=None)
    assert work.enqueued is None and work.seconds > 0


def test_all_without_limits_is_not_kept_in_memory(spark, tmp_path, monkeypatch):
    """Without limits a tick reads queues and results from their tables, and returns how many it sent."""
    w = World(spark, tmp_path, enqueued=None, most=None)
    w.sink("a", table_filter="orders")
    w.sink("off", operation_filter="update, delete", enabled=True)
    w.work.enqueue(w.registry.sinks(), "w")
    w.registry.update("sinks", "off", enabled=False)
    with monkeypatch.context() as c:
        for name in ("persist", "cache"):
            c.setattr(type(w.events), name, lambda *a, **k: pytest.fail("kept in memory"))
        n = w.tick(lambda url, body: 500)
        assert n == w.log.read().filter("table_name = 'orders'").count() == len(w.sent()) == len(set(w.sent()))
        assert w.tick(at=1) == n and w.tick(at=2) == 0
    waits = w.log.read().filter("operation <> 'insert'").count()
    assert w.states() == {("a", "retryable"): n, ("a", "success"): n, ("off", "pending"): waits}
