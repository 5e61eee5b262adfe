"""Delivery of events to sinks: matching, due work, attempts, dead letters."""

from __future__ import annotations

import http.client
import ipaddress
import socket
import time
import urllib.parse
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walflow.functions.crypto import signature
from walflow.functions.exprs import backoff_ms, format_lsn, idempotency_key, operation_listed, outcome, truncated

SINKS_BROADCAST = 20_000
#: (sink, headers, body) -> (status or None, body, error or None, whether an error may pass)
Transport = Callable[[str, dict[str, str], str], tuple[int | None, str, str | None, bool]]


def _open(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c)) == "")


_FILTERS = {"source_filter": "source_id", "schema_filter": "schema_name", "table_filter": "table_name"}


def fan_out(events: DataFrame, sinks: DataFrame) -> DataFrame:
    """Each enabled sink with each event it wants. sinks: sink_id, source_filter, schema_filter, table_filter, operation_filter, enabled, ...

    Null or empty filters mean any; operations are matched exactly. Sinks are told apart by which filters they name, at most eight kinds. An event has one key
    for each kind that there is, so all sinks meet events by one equality join; sinks are broadcast after a check of their number.
    """
    on = sinks.filter("enabled")
    named = sum((F.when(_open(f), 0).otherwise(1 << k) for k, f in enumerate(_FILTERS)), F.lit(0))
    key = lambda kind, columns: F.to_json(F.struct(*[F.when(kind.bitwiseAND(F.lit(1 << k)) != 0, F.col(c)).alias(f"k{k}") for k, c in enumerate(columns)]))
    kinds = [r[0] for r in on.select(named).distinct().collect()]  # at most eight
    wanted = on.withColumn("_kind", named).withColumn("_key", key(F.col("_kind"), _FILTERS))
    offered = events.withColumn("_kind", F.explode(F.array(*[F.lit(k) for k in kinds]).cast("array<int>"))).withColumn("_key", key(F.col("_kind"), _FILTERS.values()))
    few = on.limit(SINKS_BROADCAST + 1).count() <= SINKS_BROADCAST
    met = offered.join(F.broadcast(wanted) if few else wanted, ["_kind", "_key"]).drop("_kind", "_key")
    return met.filter(operation_listed("operation", F.col("operation_filter")))


def pending(events: DataFrame, sinks: DataFrame, attempts: DataFrame, most: int | None = None) -> DataFrame:
    """First attempts for every match that has none yet; with `most` only so many, the oldest positions first."""
    new = fan_out(events, sinks).join(attempts.select("sink_id", F.col("event_id").alias("id")).distinct(), ["sink_id", "id"], "left_anti")
    if most is not None:
        new = new.orderBy("commit_end_lsn", "sequence_number", "source_id", "sink_id").limit(most)
    return new.select("sink_id", F.col("id").alias("event_id"), F.lit(1).alias("attempt_number"), F.lit("pending").alias("status"), idempotency_key("sink_id", "id").alias("idempotency_key"), "commit_end_lsn", "sequence_number")


def due(attempts: DataFrame, as_of: str, most: int = 10) -> DataFrame:
    """The oldest attempts that are pending and due."""
    t = F.lit(as_of).cast("timestamp")
    return attempts.filter((F.col("status") == "pending") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at").cast("timestamp") <= t))).orderBy("attempt_id").limit(most)


def body() -> Column:
    """The JSON that a sink receives."""
    parts = F.struct(F.lower(F.hex("id")).alias("id"), "schema_name", "table_name", "operation", "sequence_number", format_lsn("commit_end_lsn").alias("commit_end_lsn"), "before", "after", "key_columns")
    return F.to_json(parts, {"ignoreNullFields": "false"})


def addresses(host: str) -> list[str]:
    """A host's addresses, itself if it is one."""
    try:
        return [str(ipaddress.ip_address(host))]
    except ValueError:
        pass
    try:
        return sorted({a[4][0] for a in socket.getaddrinfo(host, None, type=socket.SOCK_STREAM)})
    except OSError:
        return []


def public(address: str) -> bool:
    """Not loopback, private, link-local, multicast or unspecified, nor such an IPv4 address in IPv6 form."""
    a = ipaddress.ip_address(address.split("%")[0])
    a = getattr(a, "ipv4_mapped", None) or a
    return a.is_global and not (a.is_multicast or a.is_unspecified or a.is_loopback or a.is_link_local or a.is_private)


def public_address(host: str) -> bool:
    """Whether a host may be called: all of its addresses are public."""
    found = addresses(host)
    return bool(found) and all(map(public, found))


class _Plain(http.client.HTTPConnection):
    """A connection to the address that was judged, whatever the name resolves to by now."""

    address = ""

    def connect(self) -> None:
        self.sock = socket.create_connection((self.address, self.port), self.timeout)


class _Secure(http.client.HTTPSConnection):
    address = ""

    def connect(self) -> None:
        raw = socket.create_connection((self.address, self.port), self.timeout)
        self.sock = self._context.wrap_socket(raw, server_hostname=self.host)


def http_transport(url: str, headers: dict[str, str], payload: str, seconds: float = 30, allowed: Callable[[str], bool] = public) -> tuple[int | None, str, str | None, bool]:
    """A guarded POST: http and https only, at most three redirects, and each connection goes to an address that has been judged. seconds: for all of it."""
    end = time.monotonic() + seconds
    for _ in range(4):
        if (left := end - time.monotonic()) <= 0:
            return None, "", "out of time", True
        parts = urllib.parse.urlsplit(url)
        found = addresses(parts.hostname or "") if parts.scheme in ("http", "https") else []
        if not found or not all(map(allowed, found)):
            return None, "", "address not allowed", False
        link = (_Plain if parts.scheme == "http" else _Secure)(parts.hostname, parts.port, timeout=left)
        link.address = found[0]
        try:
            link.request("POST", urllib.parse.urlunsplit(("", "", parts.path or "/", parts.query, "")), payload.encode(), headers)
            r = link.getresponse()
            to = r.getheader("Location")
            if r.status in (301, 302, 303, 307, 308) and to:
                url = urllib.parse.urljoin(url, to)
                continue
            return r.status, r.read(4096).decode("utf-8", "replace"), None, False
        except (TimeoutError, ConnectionError) as e:
            return None, "", repr(e), True
        except (OSError, http.client.HTTPException) as e:
            return None, "", repr(e), False
        finally:
            link.close()
    return None, "", "too many redirects", False


def sent(work: DataFrame, transport: Transport, timestamp: int, kept: list[str]) -> DataFrame:
    """What came of sending each row of work (due attempts with their sink's url and secret, and the event): the columns `kept`, http_status, response_body, error, passing."""
    signed = work.withColumn("payload", body()).withColumn("signature", signature(F.col("secret"), F.lit(timestamp), F.col("id"), F.col("payload"))).withColumn("event", F.lower(F.hex("id")))
    what = F.struct("url", "event", "attempt_number", "signature", "idempotency_key", "payload")

    @F.pandas_udf("http_status int, response_body string, error string, passing boolean")
    def send(rows: pd.DataFrame) -> pd.DataFrame:
        got = []
        for w in rows.itertuples(index=False):
            headers = {"Content-Type": "application/json", "X-Signature": w.signature, "X-Timestamp": str(timestamp), "Idempotency-Key": w.idempotency_key, "X-Event-Id": w.event, "X-Attempt": str(w.attempt_number)}
            got.append(transport(w.url, headers, w.payload))
        return pd.DataFrame({"http_status": pd.array([g[0] for g in got], dtype="Int32"), "response_body": [g[1] for g in got], "error": [g[2] for g in got], "passing": [g[3] for g in got]})

    # each row must be sent once, so nothing may be moved below the call or evaluate it again
    return signed.select(*kept, send.asNondeterministic()(what).alias("came")).select(*kept, "came.*")


def delivered(work: DataFrame, transport: Transport, timestamp: int, folder: str) -> DataFrame:
    """work (due attempts with attempt_id, their sink's url, secret, max_attempts, delays and the event) with what came of each: http_status, response_body, error, status, retry_in_ms.

    The results are stored below folder under a name made of the attempts alone, before anything reads them, and found there by a call that repeats, at any later time: what is done with
    them sends nothing again. A task that runs again after a lost executor does send again, which receivers tell by the idempotency key.
    """
    spark = work.sparkSession
    digest = work.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("attempt_id", "attempt_number"), F.lit(1 << 40)))).first()
    path = f"{folder}/sent-{digest[0]}-{digest[1] or 0:x}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        sent(work, transport, timestamp, ["attempt_id"]).write.mode("overwrite").parquet(path)
    kept = work.select("attempt_id", "sink_id", "event_id", "attempt_number", "max_attempts", "retry_initial_ms", "retry_max_ms")
    return settled(spark.read.parquet(path).join(kept, "attempt_id"))


def settled(results: DataFrame) -> DataFrame:
    """Outcome and delay of the next attempt."""
    status = outcome("http_status", "attempt_number", "max_attempts", F.col("passing"))
    done = results.withColumn("response_body", truncated("response_body")).withColumn("status", status)
    return done.withColumn("retry_in_ms", F.when(F.col("status") == "retryable", backoff_ms("attempt_number", "retry_initial_ms", "retry_max_ms", idempotency_key("sink_id", "event_id"))))


def next_attempts(results: DataFrame, as_of: str, kept: list[str] | None = None) -> DataFrame:
    again = results.filter(F.col("status") == "retryable")
    at = F.timestamp_micros(F.unix_micros(F.lit(as_of).cast("timestamp")) + F.col("retry_in_ms") * 1000)
    return again.select(*(kept or []), "sink_id", "event_id", (F.col("attempt_number") + 1).alias("attempt_number"), F.lit("pending").alias("status"), at.alias("next_retry_at"), idempotency_key("sink_id", "event_id").alias("idempotency_key"))


def dead_letters(history: DataFrame) -> DataFrame:
    """A dead letter for each (sink, event) that failed for good, with all its attempts in order."""
    each = F.struct(F.col("attempt_number").alias("attempt"), "status", "http_status", "error")
    all_of = history.groupBy("sink_id", "event_id").agg(F.array_sort(F.collect_list(each)).alias("attempt_history"))  # at most max_attempts each
    return all_of.filter(F.exists("attempt_history", lambda a: a["status"] == "permanent_failure")).withColumn("status", F.lit("pending"))


def dead_letter_list(attempts: DataFrame, most: int = 100) -> DataFrame:
    """The newest attempts that failed for good."""
    return attempts.filter("status = 'permanent_failure'").orderBy(F.desc("next_retry_at"), F.desc("attempt_id")).limit(most)


def status_counts(attempts: DataFrame) -> DataFrame:
    """For each sink how many attempts there are, succeeded, wait for another try, and failed for good."""
    n = lambda s: F.count_if(F.col("status") == s)
    return attempts.groupBy("sink_id").agg(F.count(F.lit(1)).alias("total"), n("success").alias("good"), n("retryable").alias("again"), n("permanent_failure").alias("dead"))


def circuit_counts(history: DataFrame, order: list[str]) -> DataFrame:
    """For each sink whether any of its finished attempts succeeded, and how many failed after the last that did. order: columns in which attempts finished."""
    ended = history.filter("status <> 'pending'").select("sink_id", F.struct(*order, "attempt_number").alias("at"), (F.col("status") == "success").alias("good"))
    last = ended.groupBy("sink_id").agg(F.max(F.when(F.col("good"), F.col("at"))).alias("last"))
    after = ended.join(last, "sink_id").filter(F.col("last").isNull() | (F.col("at") >= F.col("last")))
    return after.groupBy("sink_id").agg(F.count_if(~F.col("good")).alias("failures"), F.bool_or("good").alias("succeeded"))


def circuit_states(history: DataFrame, failures: int, pause_ms: int, as_of: str) -> DataFrame:
    """Each sink's circuit: closed; open, from its `failures`-th failure in a row for pause_ms; half_open from then on, when one trial may go, until that succeeds (closed) or fails (open).

    history: attempts with finished_at. As nothing but trials goes out while a circuit is open, failures in a row and the time of the last tell its state.
    """
    last = history.filter("status <> 'pending'").groupBy("sink_id").agg(F.max("finished_at").alias("at"))
    waits = F.unix_millis(F.lit(as_of).cast("timestamp")) - F.unix_millis(F.col("at").cast("timestamp"))
    state = F.when(F.col("failures") < failures, "closed").when(waits < pause_ms, "open").otherwise("half_open")
    return circuit_counts(history, ["finished_at"]).join(last, "sink_id").select("sink_id", "failures", state.alias("state"))
