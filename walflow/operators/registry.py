"""Registered sources, sinks and consumer groups: a few rows each in the control store. Secrets lie there in envelopes only, and lists leave them out."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walflow.functions.crypto import enveloped, opened, sealed, unwrapped
from walflow.operators.control import ControlStore

SECRETS = ("secret", "password", "dsn", "credentials")
SINK = "sink_id string, url string, secret binary, source_filter string, schema_filter string, table_filter string, operation_filter string, enabled boolean, max_attempts int, retry_initial_ms long, retry_max_ms long, circuit_failures int, circuit_pause_ms long"
DEFAULTS = {"sinks": {"enabled": True, "max_attempts": 5, "retry_initial_ms": 1000, "retry_max_ms": 300_000, "circuit_failures": 0, "circuit_pause_ms": 60_000}, "sources": {"status": "active"}, "groups": {"partitions": 1, "max_attempts": 5, "poison": "dlq"}}
KINDS = tuple(DEFAULTS)
ENVELOPE = "struct<version:int,key_id:string,wrapped:binary,body:binary>"


class Registry:
    """keys: master keys of 32 bytes by their id; active: the id of the one that seals new secrets. The others open what was sealed before, until rotate() has re-wrapped it.

    An envelope is bound to its row's kind and name and to the field, so it opens nowhere else.
    """

    def __init__(self, store: ControlStore, keys: dict[str, bytes] | None = None, active: str | None = None) -> None:
        if active is not None and active not in (keys or {}):
            raise ValueError(f"no key {active}")
        self.store, self.keys, self.active = store, keys or {}, active

    @staticmethod
    def _context(kind: str, name: str, field: str) -> str:
        return f"{kind}/{name}/{field}"

    def _sealed(self, kind: str, name: str, row: dict) -> dict:
        """The row with its secrets in envelopes."""
        out = dict(row)
        for field in SECRETS:
            if (value := row.get(field)) is None:
                continue
            if self.active is None:
                raise ValueError(f"a key is needed to keep {field}")
            plain = value if isinstance(value, bytes) else str(value).encode()
            of = [F.lit(x) for x in (plain, os.urandom(32), self.keys[self.active])]
            e = self.store.spark.range(1).select(enveloped(*of, F.lit(self.active), F.lit(self._context(kind, name, field))).alias("e")).first()["e"]
            out[field] = {"version": e["version"], "key_id": e["key_id"], "wrapped": e["wrapped"].hex(), "body": e["body"].hex()}
        return out

    def add(self, kind: str, name: str, **row: object) -> None:
        """Raises ValueError if the name is taken."""
        if kind not in KINDS or not name:
            raise ValueError(f"{kind} {name!r}")
        kept = self._sealed(kind, name, row)

        def step(rows: dict) -> None:
            if name in rows:
                raise ValueError(f"{kind} {name} exists")
            rows[name] = DEFAULTS[kind] | kept | {"created_at": self.store.clock()}

        self.store.change(kind, step)

    def update(self, kind: str, name: str, **row: object) -> bool:
        """False if there is none of this name."""
        kept = self._sealed(kind, name, row)

        def step(rows: dict) -> bool:
            if name not in rows:
                return False
            rows[name] |= kept
            return True

        return self.store.change(kind, step)

    def remove(self, kind: str, name: str) -> bool:
        return self.store.change(kind, lambda rows: rows.pop(name, None) is not None)

    def get(self, kind: str, name: str) -> dict | None:
        """A row with its secrets as they are stored, in envelopes."""
        return self.store.read(kind)[1].get(name)

    def list(self, kind: str) -> list[dict]:
        """In order of creation, secrets left out."""
        rows = self.store.read(kind)[1]
        return [{"name": k} | {c: v for c, v in r.items() if c not in SECRETS} for k, r in sorted(rows.items(), key=lambda x: (x[1]["created_at"], x[0]))]

    def counts(self) -> dict[str, int]:
        return {kind: len(self.store.read(kind)[1]) for kind in KINDS}

    def _envelopes(self, kind: str, wanted: tuple[str, ...] = SECRETS) -> DataFrame:
        """name, field, e, context of every secret of a kind."""
        rows = [(name, f, (r[f]["version"], r[f]["key_id"], bytes.fromhex(r[f]["wrapped"]), bytes.fromhex(r[f]["body"])), self._context(kind, name, f)) for name, r in self.store.read(kind)[1].items() for f in wanted if r.get(f)]
        return self.store.spark.createDataFrame(rows, f"name string, field string, e {ENVELOPE}, context string")

    def reveal(self, kind: str, name: str, field: str) -> bytes | None:
        """A secret's bytes; None if there is none, or if it does not open under the keys and this row's name."""
        found = self._envelopes(kind, (field,)).filter(F.col("name") == name).select(unwrapped(F.col("e"), self.keys, F.col("context")).alias("x")).first()
        return found and (None if found["x"] is None else bytes(found["x"]))

    def _rewrapped(self, envelope: Column, context: Column) -> Column:
        """The envelope's data key under the active key; null if it cannot be opened."""
        old = F.coalesce(*[F.when(envelope["key_id"] == k, F.lit(v)) for k, v in self.keys.items()], F.lit(None).cast("binary"))
        return sealed(opened(envelope["wrapped"], old, context), F.lit(self.keys[self.active]), context)

    def rotate(self) -> int:
        """Wraps the data keys of all secrets under the active key; their bodies stay. Returns how many were wrapped anew. Safe to repeat, and beside changes of the same rows."""
        if self.active is None:
            raise ValueError("no active key")
        n = 0
        for kind in KINDS:
            old = self._envelopes(kind).filter(F.col("e.key_id") != self.active)
            found = old.select("name", "field", F.hex("e.wrapped").alias("before"), self._rewrapped(F.col("e"), F.col("context")).alias("wrapped")).filter("wrapped is not null").collect()  # the registry's rows

            def step(rows: dict, found: list = found) -> int:
                done = 0
                for r in found:
                    held = rows.get(r["name"], {}).get(r["field"])
                    if held and held["wrapped"] == r["before"].lower():  # else it was set anew meanwhile
                        held |= {"key_id": self.active, "wrapped": r["wrapped"].hex()}
                        done += 1
                return done

            n += self.store.change(kind, step) if found else 0
        return n

    def sinks(self) -> DataFrame:
        """The sinks as fan_out() and the delivery cycle take them, their secrets opened where the DataFrame is computed. One that does not open is null."""
        names = [c.strip().split(" ")[0] for c in SINK.split(",")]
        rows = [tuple(({"sink_id": k} | r | {"secret": None}).get(c) for c in names) for k, r in self.store.read("sinks")[1].items()]
        plain = self.store.spark.createDataFrame(rows, SINK)
        secrets = self._envelopes("sinks", ("secret",)).select(F.col("name").alias("sink_id"), unwrapped(F.col("e"), self.keys, F.col("context")).alias("secret"))
        return plain.drop("secret").join(secrets, "sink_id", "left").select(*names)
