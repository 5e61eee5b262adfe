"""Native column expressions for change-data-capture logs: positions, partition hashes, payload hashes, retry rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The FNV-1a 32-bit offset and prime, and type numbers of the source database by how their text becomes JSON.
FNV_OFFSET, FNV_PRIME, MASK32 = 2166136261, 16777619, 4294967295
JSON_TYPES, BOOL_TYPES, NUMBER_TYPES = (114, 3802), (16,), (21, 23, 20, 700, 701, 1700)
#: HTTP statuses worth another attempt besides 5xx; bytes counted for an event and for a value.
RETRYABLE = (408, 425, 429)
EVENT_BYTES, VALUE_BYTES = 200, 16

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_lsn(text: ColumnOrName) -> Column:
    """'16/B374D848' -> 97500059720. Null unless it is two hexadecimal numbers of at most eight digits with a value below 2**63."""
    t = _c(text)
    ok = t.rlike("^[0-7]?[0-9A-Fa-f]{1,7}/[0-9A-Fa-f]{1,8}$")
    half = lambda i: F.conv(F.split_part(t, F.lit("/"), F.lit(i)), 16, 10).cast("long")
    return F.when(ok, F.shiftleft(half(1), 32) + half(2))


def format_lsn(lsn: ColumnOrName) -> Column:
    n = _c(lsn)
    return F.concat(F.hex(F.shiftrightunsigned(n, 32)), F.lit("/"), F.hex(n.bitwiseAND(F.lit(MASK32))))


def position(lsn: ColumnOrName = "commit_end_lsn", seq: ColumnOrName = "sequence_number") -> Column:
    """Positions compare as structs: by log position, then by place in the transaction."""
    return F.struct(_c(lsn).alias("lsn"), _c(seq).alias("seq"))


def format_position(lsn: ColumnOrName, seq: ColumnOrName) -> Column:
    return F.concat_ws(":", format_lsn(lsn), _c(seq).cast("string"))


def after(lsn: int | None, seq: int | None) -> Column:
    """The keyset predicate: strictly after a position; everything if there is none yet."""
    if lsn is None:
        return F.lit(True)
    return (F.col("commit_end_lsn") >= lsn) & ((F.col("commit_end_lsn") > lsn) | (F.col("sequence_number") > (seq or 0)))


@F.pandas_udf(T.LongType())
def _fnv1a32(texts: pd.Series) -> pd.Series:
    """The distinct texts of a batch advance together, a byte a step: Spark's own functions would take bytes one by one through an interpreted loop."""
    number, distinct = pd.factorize(texts)
    coded = sorted(((t.encode(), k) for k, t in enumerate(distinct.tolist())), key=lambda x: -len(x[0]))
    size = np.array([len(c) for c, _ in coded], np.int64)
    raw, start = np.frombuffer(b"".join(c for c, _ in coded), np.uint8), np.cumsum(size) - size
    h = np.full(len(coded), FNV_OFFSET, np.uint64)
    for i in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -i, side="left"))  # so many texts are longer than i
        h[:n] = (h[:n] ^ raw[start[:n] + i]) * np.uint64(FNV_PRIME) & np.uint64(MASK32)
    out = np.zeros(len(coded) + 1, np.int64)
    out[[k for _, k in coded]] = h.astype(np.int64)
    return pd.Series(out[number]).astype("Int64").mask(number < 0)


def fnv1a32(text: ColumnOrName) -> Column:
    """FNV-1a over the UTF-8 bytes, an unsigned 32-bit number as a long. The empty text gives the offset."""
    return _fnv1a32(_c(text))


def normalized_key(key: ColumnOrName) -> Column:
    """A key map as 'k=v;' for each entry in order of k; an empty map is empty."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(_c(key))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")), F.lit(";"))), "")


def partition_of(key_hash: ColumnOrName, partitions: int) -> Column:
    return (F.pmod(_c(key_hash), F.lit(partitions)) if partitions > 0 else F.lit(0)).cast("int")


def assigned_member(partition: ColumnOrName, members: ColumnOrName) -> Column:
    """Round robin of partitions over the sorted members; null without members."""
    m = F.sort_array(_c(members))
    return F.when(F.size(m) > 0, F.try_element_at(m, F.pmod(_c(partition), F.greatest(F.size(m), F.lit(1))).cast("int") + 1))


def sorted_map(m: ColumnOrName) -> Column:
    return F.when(F.size(_c(m)) <= 1, _c(m)).otherwise(F.map_from_entries(F.sort_array(F.map_entries(_c(m)))))


def payload_hash() -> Column:
    """SHA-256 of the event as JSON: identity, table, operation, both images and key with map keys in order and nulls written."""
    fields = ["source_id", "commit_end_lsn", "sequence_number", "schema_name", "table_name", "operation"]
    images = [sorted_map("before").alias("before"), sorted_map("after").alias("after"), sorted_map("key_columns").alias("key")]
    return F.sha2(F.to_json(F.struct(*fields, *images), {"ignoreNullFields": "false"}), 256)


def event_id() -> Column:
    """16 bytes that follow from the natural key, so that tasks that run again agree."""
    return F.unhex(F.substring(F.sha2(F.concat_ws("|", "source_id", F.col("commit_end_lsn").cast("string"), F.col("sequence_number").cast("string")), 256), 1, 32))


def relation_fingerprint(schema: ColumnOrName, table: ColumnOrName, columns: ColumnOrName) -> Column:
    """32 hexadecimal digits over the names and, for each column, 'name:type:nullable:position;'."""
    each = F.transform(_c(columns), lambda c: F.concat(c["name"], F.lit(":"), c["type_oid"].cast("string"), F.lit(":"), c["nullable"].cast("string"), F.lit(":"), c["position"].cast("string"), F.lit(";")))
    return F.substring(F.sha2(F.concat(_c(schema), _c(table), F.array_join(each, "")), 256), 1, 32)


def json_value(text: ColumnOrName, type_oid: ColumnOrName) -> Column:
    """A column's text as JSON text: JSON and numbers as they are where valid, booleans as words, all else a JSON string."""
    t, oid = _c(text), _c(type_oid)
    quoted = F.transform(F.array(F.to_json(F.struct(t.alias("v")))), lambda j: F.substring(j, F.lit(6), F.length(j) - 6))[0]  # what is between {"v": and }
    number = t.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")
    return F.when(oid.isin(*JSON_TYPES) & F.try_parse_json(t).isNotNull(), t).when(oid.isin(*BOOL_TYPES) & t.isin("t", "f"), F.when(t == "t", "true").otherwise("false")).when(oid.isin(*NUMBER_TYPES) & number, t).otherwise(quoted)


def estimated_bytes(before: ColumnOrName = "before", after: ColumnOrName = "after") -> Column:
    size = lambda m: F.coalesce(F.aggregate(F.map_values(_c(m)), F.lit(0).cast("long"), lambda s, v: s + F.coalesce(F.octet_length(v["value"]), F.lit(0)) + VALUE_BYTES), F.lit(0).cast("long"))
    return size(before) + size(after) + EVENT_BYTES


def retryable(http_status: ColumnOrName) -> Column:
    s = _c(http_status)
    return s.isin(*RETRYABLE) | s.between(500, 599)


def outcome(http_status: ColumnOrName, attempt: ColumnOrName, most: ColumnOrName, network_retryable: Column | None = None) -> Column:
    """success, retryable or permanent_failure. Without a status, network_retryable says whether the error may pass."""
    s = _c(http_status)
    again = F.coalesce(retryable(s), network_retryable if network_retryable is not None else F.lit(False))
    return F.when(s.between(200, 299), "success").when(again & (_c(attempt) < _c(most)), "retryable").otherwise("permanent_failure")


def backoff_ms(attempt: ColumnOrName, initial_ms: ColumnOrName, most_ms: ColumnOrName, jitter_key: ColumnOrName | None = None) -> Column:
    """min(initial * 2**(attempt - 1), most); with a jitter key up to a quarter more or less, the same for the same key and attempt."""
    base = F.least(_c(initial_ms).cast("double") * F.pow(F.lit(2.0), F.least(_c(attempt), F.lit(62)) - 1), _c(most_ms).cast("double"))
    if jitter_key is not None:
        base = base * (F.lit(0.75) + F.pmod(F.xxhash64(_c(jitter_key), _c(attempt)), F.lit(1_000_000)) / 2_000_000)
    return F.floor(base).cast("long")


def idempotency_key(sink: ColumnOrName, event: ColumnOrName) -> Column:
    return F.concat_ws(":", _c(sink), F.lower(F.hex(_c(event))))


def truncated(text: ColumnOrName, size: int = 1024) -> Column:
    """At most `size` bytes of UTF-8, without half a character at the end."""
    cut = F.substring(F.encode(_c(text), "UTF-8"), 1, size)
    return F.regexp_replace(F.decode(cut, "UTF-8"), "�+$", "")


def operation_listed(operation: ColumnOrName, listed: ColumnOrName) -> Column:
    """Whether a comma list with blanks holds the operation exactly; null or empty means any."""
    lst = _c(listed)
    return lst.isNull() | (F.trim(lst) == "") | F.array_contains(F.transform(F.split(lst, ","), lambda x: F.trim(x)), _c(operation))
