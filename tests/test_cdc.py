import hashlib
import hmac
import http.server
import json
import os
import threading
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from walflow.functions import crypto, exprs
from walflow.operators.consumer import ConsumerGroup, OffsetRegression
from walflow.operators.control import Checkpoints, ControlStore, Fenced, Leases, PositionRegression
from walflow.operators.delivery import delivered, http_transport, public_address
from walflow.operators.ingest import HashMismatch, ingest, ingest_fenced, stored
from walflow.operators.registry import Registry
from walflow.operators.replay import Replays
from walflow.plans import catalog
from walflow.sources import wal
from walflow.sources.commerce import order_changes

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_vectors(spark):
    r = one(spark, *[exprs.fnv1a32(F.lit(s)) for s in ("", "a", "foobar")], exprs.parse_lsn(F.lit("16/B374D848")), exprs.format_lsn(F.lit(97500059720)), exprs.parse_lsn(F.lit("x/1")))
    assert list(r) == [2166136261, 3826002220, 3214735720, 97500059720, "16/B374D848", None]


def test_signature(spark):
    r = one(spark, crypto.signature(F.lit(b"k"), F.lit(5), F.lit(b"e"), F.lit("p")))
    assert crypto.verified(r[0], b"k", 5, b"e", "p") and not crypto.verified(r[0], b"k", 6, b"e", "p")


@pytest.mark.parametrize("host,ok", [("127.0.0.1", False), ("10.0.0.1", False), ("169.254.1.1", False), ("224.0.0.1", False), ("0.0.0.0", False), ("::1", False), ("8.8.8.8", True)])
def test_addresses(host, ok):
    assert public_address(host) is ok


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    text = lambda rows: sorted(tuple("%.9g" % x if isinstance(x, float) else str(float(x)) if type(x).__name__ == "Decimal" else str(x) for x in r) for r in rows)
    assert text(tuple(r) for r in df.select(*cols).collect()) == text(duck.sql(f"select {', '.join(cols)} from ({catalog.ORACLE_SQL[name]})").fetchall())


def test_ingest_twice_and_mismatch(spark, tmp_path):
    events = order_changes(spark, SF).filter("commit_end_lsn <= 51200")
    path = f"file://{tmp_path}/store"
    n = ingest(spark, events, path)
    assert n == events.count() and ingest(spark, events, path) == 0
    with pytest.raises(HashMismatch):
        ingest(spark, events.withColumn("operation", F.lit("delete")), path)
    assert spark.read.parquet(path).count() == n


def test_control(spark, tmp_path):
    now = [100.0]
    store = ControlStore(spark, f"file://{tmp_path}/c", clock=lambda: now[0])
    leases = Leases(store)
    g = leases.claim("p", "a")
    assert leases.claim("p", "b") is None and leases.heartbeat("p", "a", g)
    now[0] += 60
    h = leases.claim("p", "b")
    assert h == g + 1 and not leases.heartbeat("p", "a", g)
    points = Checkpoints(store)
    c = points.claim("s", "a")
    points.advance("s", "a", c, received=50, persisted=20)
    assert points.lag_bytes("s") == 30
    with pytest.raises(Fenced):
        points.advance("s", "a", c - 1, persisted=30)


@pytest.mark.parametrize("poison", ["dlq", "halt"])
def test_consumer(spark, tmp_path, poison):
    now = [0.0]
    store = ControlStore(spark, f"file://{tmp_path}/c", clock=lambda: now[0])
    events = stored(order_changes(spark, SF).filter("commit_end_lsn <= 20480")).cache()
    group = ConsumerGroup(store, "g", "orders", 1, max_attempts=2, poison=poison)
    b = group.poll(events, "m", 3)
    assert len(b.issued) == 3 and group.poll(events, "other", 3).partition is None
    with pytest.raises(ValueError):
        group.nack(b.partition, "m", b.generation, b.issued[1])
    assert group.nack(b.partition, "m", b.generation, b.issued[0], 5) == "retry_scheduled"
    assert group.poll(events, "m", 3).next_delivery_at == 5
    now[0] = 6
    b = group.poll(events, "m", 3)
    assert group.nack(b.partition, "m", b.generation, b.issued[0]) == {"dlq": "dead_lettered", "halt": "halted"}[poison]
    if poison == "halt":
        assert group.poll(events, "m").partition is None
        group.resume(0)
        return
    assert group.dead_letters("pending")[0]["event_id"] == b.issued[0]
    b = group.poll(events, "m", 2)
    last = b.events.collect()[-1]
    group.ack(0, "m", b.generation, last["commit_end_lsn"], last["sequence_number"])
    with pytest.raises(OffsetRegression):
        group.ack(0, "m", b.generation, 1, 1)
    with pytest.raises(Fenced):
        group.ack(0, "m", b.generation - 1, 10**9, 1)


def test_delivery(spark, tmp_path):
    events = stored(order_changes(spark, SF).filter("commit_end_lsn <= 4096"))
    work = events.withColumns({"attempt_id": F.col("commit_end_lsn") * 64 + F.col("sequence_number"), "sink_id": F.lit("s"), "event_id": F.col("id"), "attempt_number": F.lit(1), "max_attempts": F.lit(2), "retry_initial_ms": F.lit(1000), "retry_max_ms": F.lit(5000), "url": F.lit("http://x"), "secret": F.lit(b"k"), "idempotency_key": F.lit("i")})
    log = f"{tmp_path}/sent.log"

    def answer(u, h, p):
        with open(log, "a") as f:
            f.write(h["X-Event-Id"] + h["X-Attempt"] + "\n")
        return (200 if json.loads(p)["table_name"] == "orders" else 500), "", None, False

    got = delivered(work, answer, 1, f"file://{tmp_path}/results")
    assert {r["status"] for r in got.collect()} == {"success", "retryable"} and got.count() == events.count()
    assert delivered(work, answer, 1, f"file://{tmp_path}/results").count() == len(open(log).read().split()) == events.count()


def test_published_hmac(spark):
    """RFC 4231, test case 2, as the signature's last part."""
    assert hmac.new(b"Jefe", b"what do ya want for nothing?", hashlib.sha256).hexdigest() == "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"
    r = one(spark, crypto.signature(F.lit(b"Jefe"), F.lit(5), F.lit(b""), F.lit("p")))
    assert r[0] == "sha256=" + hmac.new(b"Jefe", b"5.p", hashlib.sha256).hexdigest()


@pytest.mark.parametrize("status,headers,want", [(200, {}, (200, None)), (503, {}, (503, None)), (302, {"Location": "/next"}, (None, "too many redirects")), (302, {"Location": "ftp://example.com/"}, (None, "address not allowed"))])
def test_transport(status, headers, want):
    seen = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers["X-A"], self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.send_header("Content-Length", "0")
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/hook"
    got = http_transport(url, {"X-A": "1"}, "body", 5, allowed=lambda a: True)
    assert (got[0], got[2]) == want and seen[0] == ("/hook", "1", b"body")
    assert http_transport(url, {}, "body", 5)[2] == "address not allowed" and http_transport("file:///etc/hostname", {}, "")[2] == "address not allowed"
    server.shutdown()
    assert http_transport(url.replace(str(server.server_port), "9"), {}, "", 2, allowed=lambda a: True)[3]


def test_control_after_dead_writer(spark, tmp_path):
    """A half-written version blocks only as long as its writer may be at work; a slow writer that was passed over starts over."""
    store = ControlStore(spark, f"file://{tmp_path}/c", grace=0.5)
    store.change("t", lambda r: r.update(a=1))
    (tmp_path / "c" / "t.v.2").write_text('{"base": 1, "ro')
    assert store.read("t")[1] == {"a": 1}
    store.change("t", lambda r: r.update(b=2))
    assert store.read("t") == (3, {"a": 1, "b": 2})
    tries = []

    def slow(rows):
        tries.append(1)
        if len(tries) == 1:  # another writer passes this one over: it used the next number and is done before
            (tmp_path / "c" / "t.v.5").write_text(json.dumps({"base": 3, "rows": rows | {"c": 3}}) + "\n")
            os.utime(tmp_path / "c" / "t.v.5")
        rows["d"] = 4

    store.change("t", slow)
    assert store.read("t")[1] == {"a": 1, "b": 2, "c": 3, "d": 4} and len(tries) == 2


def test_fenced_consumer_and_ingestion(spark, tmp_path):
    now = [0.0]
    store = ControlStore(spark, f"file://{tmp_path}/c", clock=lambda: now[0])
    events = stored(order_changes(spark, SF).filter("commit_end_lsn <= 8192")).cache()
    group = ConsumerGroup(store, "g", "orders", 1, max_attempts=1, lease_seconds=10)
    old = group.poll(events, "a", 3)
    now[0] = 20
    new = group.poll(events, "b", 3)
    with pytest.raises(Fenced):
        group.ack(0, "a", old.generation, 10**9, 1)
    assert group.offset(0) == (None, None) and new.generation == old.generation + 1
    now[0] = 40
    g = group.leases.claim("lease/0", "c")
    with pytest.raises(ValueError):  # issued to b, never polled by c
        group.nack(0, "c", g, new.issued[0])
    group.leases.release("lease/0", "c", g)
    b = group.poll(events, "c", 3)
    assert group.nack(0, "c", b.generation, b.issued[0]) == "dead_lettered"
    group.resolve(b.issued[0], "retried")
    assert group.dead_letters("pending") == [] and [d["status"] for d in group.dead_letters()] == ["retried"]
    points, path = Checkpoints(store), f"file://{tmp_path}/store"
    c = points.claim("orders", "a")
    n = ingest_fenced(spark, order_changes(spark, SF).filter("commit_end_lsn <= 4096"), path, points, "orders", "a", c)
    assert n > 0 and points.get("orders")["persisted"] == points.get("orders")["received"] == 4096
    now[0] = 100
    points.claim("orders", "b")
    with pytest.raises(Fenced):
        ingest_fenced(spark, order_changes(spark, SF).filter("commit_end_lsn <= 8192"), path, points, "orders", "a", c)
    with pytest.raises(PositionRegression):
        points.advance("orders", "b", c + 1, persisted=1)


def test_registry_and_seek(spark, tmp_path):
    store = ControlStore(spark, f"file://{tmp_path}/c")
    with pytest.raises(ValueError):
        Registry(store).add("sinks", "s", url="https://example.com", secret="hidden")
    r = Registry(store, {"old": b"o" * 32}, "old")
    r.add("sinks", "s", url="https://example.com", secret="hidden")
    r.add("sources", "orders", dsn="hidden")
    with pytest.raises(ValueError):
        r.add("sinks", "s", url="x")
    assert r.update("sinks", "s", enabled=False) and not r.update("sinks", "t", enabled=False)
    assert r.counts() == {"sinks": 1, "sources": 1, "groups": 0} and "hidden" not in str(r.list("sinks") + r.list("sources")) and r.sinks().first()["secret"] == b"hidden"
    events = stored(order_changes(spark, SF).filter("commit_end_lsn <= 8192")).cache()
    group, sessions = ConsumerGroup(store, "g", "orders", 1), Replays(store)
    b = group.poll(events, "m", 10)
    group.ack(0, "m", b.generation, 8192, 1)
    group.leases.release("lease/0", "m", b.generation)
    sessions.create("x", start={"lsn": 4096}, destination="consumer", source_id="orders")
    assert sessions.seek("x", events, group, "replayer") == 1 and group.poll(events, "m", 1).events.first()["commit_end_lsn"] == 4096
    assert [s["name"] for s in sessions.list("orders")] == ["x"] and sessions.list("other") == []


def test_limits_and_errors(spark, tmp_path):
    from walflow.operators.ingest import LimitExceeded, check_open
    from walflow.sources import scenarios

    open_ones = scenarios.load(spark, "medium", 1).filter("kind <> 'commit' and xid <= 3")
    assert check_open(open_ones, 3).count() == 3
    for limit in ({"most_open": 2}, {"most_open": 3, "max_events": 49}, {"most_open": 3, "max_bytes": 100}):
        with pytest.raises(LimitExceeded):
            check_open(open_ones, **limit)
    log = spark.createDataFrame([("s", 1, "truncate")], "source_id string, pos long, kind string")
    with pytest.raises(Exception, match="message kind truncate at position 1"):
        wal.checked(log).collect()
    wide = spark.sql("select array(named_struct('state', 'value', 'text', '1'), named_struct('state', 'value', 'text', '2')) v, array(named_struct('name', 'a', 'type_oid', 20L)) c")
    with pytest.raises(Exception, match="wider"):
        wide.select(wal.tuple_image("v", "c")).collect()
    states = spark.sql("select array(named_struct('state', 'null', 'text', null), named_struct('state', 'unchanged_toast', 'text', null), named_struct('state', 'other', 'text', '2')) v, transform(array('a', 'b', 'c'), x -> named_struct('name', x, 'type_oid', 20L)) c")
    assert {k: x["_state"] for k, x in states.select(wal.tuple_image("v", "c")).first()[0].items()} == {"a": "null", "b": "unchanged_toast", "c": "absent"}
    r = one(spark, exprs.truncated(F.lit("é" * 600)), exprs.format_position(F.lit(1 << 33), F.lit(4)))
    assert len(r[0].encode()) == 1024 and r[1] == "2/0:4"


def test_replay(spark, tmp_path):
    store = ControlStore(spark, f"file://{tmp_path}/c")
    events = stored(order_changes(spark, SF))
    r = Replays(store)
    r.create("x", start={"lsn": 1024}, end={"lsn": 10240}, table_filter="orders", destination="jsonl", path=f"file://{tmp_path}/out")
    n = r.run("x", events)
    assert n == spark.read.json(f"file://{tmp_path}/out").count() > 0 and r.get("x")["status"] == "completed" and not r.cancel("x")


def test_replay_goes_on(spark, tmp_path, monkeypatch):
    """A session that broke off goes on behind the slices it has sent."""
    from walflow.operators import replay

    monkeypatch.setattr(replay, "SLICE", 40, raising=False)
    events = stored(order_changes(spark, SF)).filter("commit_end_lsn <= 10240").cache()
    r, sent, fail = Replays(ControlStore(spark, f"file://{tmp_path}/c")), [], [True]

    def send(part):
        rows = [(x["source_id"], x["commit_end_lsn"], x["sequence_number"]) for x in part.select("source_id", "commit_end_lsn", "sequence_number").collect()]
        if sent and fail:
            fail.clear()
            raise OSError("broken off")
        sent.extend(rows)

    r.create("x")
    with pytest.raises(OSError):
        r.run("x", events, send)
    first = len(sent)
    assert 0 < first < events.count() and r.get("x")["events_processed"] == first
    assert r.run("x", events, send) == events.count() - first and len(sent) == len(set(sent)) == events.count() and r.get("x")["status"] == "completed"


def test_sealed_registry(spark, tmp_path):
    store = ControlStore(spark, f"file://{tmp_path}/c")
    one_key = Registry(store, {"old": b"o" * 32}, "old")
    one_key.add("sinks", "a", url="u", secret="clear-text")
    one_key.add("sources", "db", dsn="postgres://clear-text")
    files = lambda: "".join(open(f"{tmp_path}/c/{n}", "rb").read().decode("latin-1") for n in os.listdir(f"{tmp_path}/c") if ".v." in n)
    assert "clear-text" not in files() and "clear-text" not in str(one_key.get("sources", "db")) and "dsn" not in one_key.list("sources")[0]
    both = Registry(store, {"old": b"o" * 32, "new": b"n" * 32}, "new")
    assert both.reveal("sources", "db", "dsn") == b"postgres://clear-text" and both.reveal("sources", "x", "dsn") is None
    assert both.rotate() == 2 and both.rotate() == 0
    after = Registry(store, {"new": b"n" * 32}, "new")
    assert after.reveal("sources", "db", "dsn") == b"postgres://clear-text" and after.sinks().first()["secret"] == b"clear-text"
    assert one_key.reveal("sources", "db", "dsn") is None and one_key.sinks().first()["secret"] is None
    store.change("sinks", lambda rows: rows.update(b=dict(rows["a"])))
    assert after.reveal("sinks", "b", "secret") is None, "an envelope opens under its own name alone"
    assert after.remove("sinks", "a") and not after.remove("sinks", "a") and "clear-text" not in files()


def test_passed_over_writer(spark, tmp_path, monkeypatch):
    """A writer that finishes while its successor's file is still empty does not lose its rows, whether that successor finishes or not."""
    for finishes in (True, False):
        store = ControlStore(spark, f"file://{tmp_path}/{finishes}", grace=1.0)
        store.change("t", lambda rows: rows.update(n=1))
        folder, steps = f"{tmp_path}/{finishes}", []

        def successor():
            open(f"{folder}/t.v.3", "w").close()

        def finish():
            time.sleep(0.3)
            with open(f"{folder}/t.v.3", "w") as f:
                f.write(json.dumps({"base": 1, "rows": {"n": 1, "other": 1}}) + "\n")

        def step(rows):
            if not steps:
                successor()
                if finishes:
                    threading.Thread(target=finish).start()
            steps.append(1)
            rows["n"] += 1

        store.change("t", step)
        assert store.read("t")[1] == ({"n": 2, "other": 1} if finishes else {"n": 2})
        assert len(steps) == (2 if finishes else 1)
        if not finishes:
            finish()
            assert store.read("t")[1] == {"n": 2}, "a dead writer that comes back replaces nothing"


def test_replay_names(spark, tmp_path):
    r = Replays(ControlStore(spark, f"file://{tmp_path}/c"))
    r.create("x", destination="jsonl", path="p")
    with pytest.raises(ValueError):
        r.create("x", destination="jsonl", path="q")
    assert r.get("x")["path"] == "p"


def test_seek_again(spark, tmp_path):
    """A seek that broke off may run again; two at a time may not."""
    store = ControlStore(spark, f"file://{tmp_path}/c")
    r, events = Replays(store), stored(order_changes(spark, SF).filter("commit_end_lsn <= 20480"))
    group = ConsumerGroup(store, "g", "orders", 2)
    r.create("x", start={"lsn": 5120}, destination="consumer")
    seek, group.seek = group.seek, lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        r.seek("x", events, group, "m")
    group.seek = seek
    held = r.leases.claim("x", "other")
    with pytest.raises(Fenced):
        r.seek("x", events, group, "m")
    r.leases.release("x", "other", held)
    assert r.seek("x", events, group, "m") == 2 and r.get("x")["status"] == "completed"


def test_fenced_nack_leaves_no_letter(spark, tmp_path, monkeypatch):
    now = [0.0]
    store = ControlStore(spark, f"file://{tmp_path}/c", clock=lambda: now[0])
    events = stored(order_changes(spark, SF).filter("commit_end_lsn <= 4096"))
    group = ConsumerGroup(store, "g", "orders", 1, max_attempts=1)
    b = group.poll(events, "m", 2)
    now[0] = 1000
    group.poll(events, "other", 2)
    with pytest.raises(Fenced):
        group.nack(b.partition, "m", b.generation, b.issued[0])
    assert group.dead_letters() == []
    again = group.poll(events, "other", 2)
    monkeypatch.setattr(group, "_note", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        group.nack(again.partition, "other", again.generation, again.issued[0])
    monkeypatch.undo()
    assert [d["event_id"] for d in group.dead_letters()] == [again.issued[0]], "a letter waits until it is stored"


def test_relations_of_two_sources(spark):
    from walflow.operators.events import as_of_relation

    rows = spark.createDataFrame([("a", 1, 10), ("b", 1, 10), ("b", 1, 3)], "source_id string, oid long, pos long")
    relations = spark.createDataFrame([("a", 1, 5, "fa"), ("b", 1, 4, "fb")], "source_id string, oid long, pos long, fingerprint string")
    assert {tuple(r) for r in as_of_relation(rows, relations).collect()} == {("a", 1, 10, "fa"), ("b", 1, 10, "fb"), ("b", 1, 3, None)}
    bad = spark.createDataFrame([("relation", "nothing"), ("relation", "full"), ("insert", "nothing")], "kind string, replica_identity string")
    assert wal.validated_identity(bad).count() == 1


def test_first_batch_of_two_versions(spark, tmp_path):
    events = order_changes(spark, SF).filter("commit_end_lsn <= 2048")
    with pytest.raises(HashMismatch):
        ingest(spark, events.unionByName(events.withColumn("operation", F.lit("delete"))), f"file://{tmp_path}/s")
    assert ingest(spark, events.unionByName(events), f"file://{tmp_path}/s") == events.count()


def test_replay_to_webhook(spark, tmp_path, monkeypatch):
    from walflow.operators import replay

    monkeypatch.setattr(replay, "SLICE", 7)
    monkeypatch.setattr(replay, "WAVE", 3)
    store, log = ControlStore(spark, f"file://{tmp_path}/c"), f"{tmp_path}/posted.log"
    registry = Registry(store, {"k": b"k" * 32}, "k")
    registry.add("sinks", "s", url="http://x", secret="key")
    events = stored(order_changes(spark, SF).filter("commit_end_lsn <= 20480"))
    r = Replays(store)
    r.create("again", end={"lsn": 18432}, destination="webhook", sink="s", path=f"file://{tmp_path}/results")
    r.create("lost", destination="webhook", sink="none", path=f"file://{tmp_path}/other")
    r.create("lines", destination="jsonl", path=f"file://{tmp_path}/lines")

    def answer(url, headers, payload):
        with open(log, "a") as f:
            f.write(f"{headers['Idempotency-Key']} {headers['X-Signature'][:7]}\n")
        return (200 if json.loads(payload)["table_name"] == "orders" else 410), "", None, False

    n = r.run("again", events, sinks=registry.sinks(), transport=answer)
    wanted = events.filter("commit_end_lsn <= 18432")
    sent = open(log).read().split("\n")[:-1]
    assert n == wanted.count() == len(sent) == len(set(sent)) > 21 and all(x.startswith("replay-again:") and x.endswith("sha256=") for x in sent)
    bad = wanted.filter("table_name <> 'orders'").count()
    results = spark.read.parquet(f"{tmp_path}/results")
    assert r.get("again")["failed"] == bad == results.filter("status = 'permanent_failure'").count() and r.get("again")["status"] == "completed" and results.count() == n
    with pytest.raises(ValueError):
        r.run("lost", events, sinks=registry.sinks(), transport=answer)
    assert r.run("lines", events) == events.count() == spark.read.text(f"{tmp_path}/lines").distinct().count() and r.get("lines")["last_lsn"] == events.agg(F.max("commit_end_lsn")).first()[0]
    assert replay.as_text(events).filter("line like '%public.orders insert {%}'").count() == events.filter("operation = 'insert' and table_name = 'orders'").count()


def test_places_of_items_need_few_columns(spark):
    """Only the columns that decide an item's event move, and events are those of the order by all columns."""
    from pyspark.sql.window import Window

    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    items = items.unionByName(items.filter("l_orderkey % 5 = 0").withColumn("l_quantity", F.col("l_quantity") + 1))
    place = 1 + F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*items.columns))
    key = ["l_orderkey", "l_partkey", "l_linenumber"]
    want = items.withColumn("n", place).select("n", *key)
    few = 1 + F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber"))
    assert sorted(items.withColumn("n", few).select("n", *key).collect()) == sorted(want.collect())
    changes = order_changes(spark, SF)
    text = changes._jdf.queryExecution().executedPlan().toString()
    assert "l_suppkey" in text and "l_extendedprice" not in text
