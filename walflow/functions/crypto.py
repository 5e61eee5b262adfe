"""Signatures and sealed secrets."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def signature(secret: pd.Series, timestamp: pd.Series, event: pd.Series, payload: pd.Series) -> pd.Series:
    """'sha256=' and the HMAC-SHA256 of '<timestamp>.', the event id's bytes and the payload. Spark has no HMAC of its own."""

    def one(k: bytes, t: int, e: bytes, p: str) -> str:
        return "sha256=" + hmac.new(k or b"", f"{t}.".encode() + (e or b"") + (p or "").encode(), hashlib.sha256).hexdigest()

    return pd.Series([one(*x) for x in zip(secret, timestamp, event, payload, strict=True)], dtype=object)


def verified(given: str, secret: bytes, timestamp: int, event: bytes, payload: str) -> bool:
    want = "sha256=" + hmac.new(secret, f"{timestamp}.".encode() + event + payload.encode(), hashlib.sha256).hexdigest()
    return hmac.compare_digest(given, want)


def sealed(plain: Column, key: Column, context: Column) -> Column:
    """AES-GCM under a 32-byte key, bound to a context that must be given again to open it."""
    return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), context)


def opened(sealed_value: Column, key: Column, context: Column) -> Column:
    """The plain bytes; null with the wrong key or context or a changed value."""
    return F.try_aes_decrypt(sealed_value, key, F.lit("GCM"), F.lit("DEFAULT"), context)


def enveloped(plain: Column, data_key: Column, master_key: Column, key_id: Column, context: Column) -> Column:
    """version, key id, the data key sealed under the master key, and the value sealed under the data key. The data key should be random per value."""
    return F.struct(F.lit(1).alias("version"), key_id.alias("key_id"), sealed(data_key, master_key, context).alias("wrapped"), sealed(plain, data_key, context).alias("body"))


def unwrapped(envelope: Column, master_keys: dict[str, bytes], context: Column) -> Column:
    """Opens an envelope with whichever of the master keys it names, so that old values stay readable after a new key comes in."""
    key = F.coalesce(*[F.when(envelope["key_id"] == k, F.lit(v)) for k, v in master_keys.items()], F.lit(None).cast("binary"))
    return F.when(envelope["version"] == 1, opened(envelope["body"], opened(envelope["wrapped"], key, context), context))
