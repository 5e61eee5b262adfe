"""Exact deduplication by two passes over a Bloom filter.

Pass one turns each partition's text hashes into bitmaps of "seen" and "seen again", which are merged segment by segment: a bit that two partitions
both set counts as seen again. Pass two looks every hash up among the bits seen again. Only rows whose hash may be repeated shuffle; the others pass
straight through. False alarms cost a little shuffling and never change the result, since repeated rows are settled by their SHA-256.

The merged filter has BITS_PER_ROW bits a row and never more than MAX_SEGMENTS * SEGMENT_BITS bits (64 MB), so what is broadcast has a fixed bound;
past some 30 million rows it fills up gradually, more rows shuffle, and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walflow.llm.common import named_row, saved, small_batches, unnamed_row

SEGMENT_BITS = 1 << 20
MAX_SEGMENTS = 512
BITS_PER_ROW = 16


def normalised(text: Column) -> Column:
    """Null is empty; every run of space, tab, line feed, vertical tab, form feed and carriage return is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _places(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each hash and its two bits there."""
    u = h.astype(np.int64).view(np.uint64)
    segment = ((u >> np.uint64(44)) % np.uint64(segments)).astype(np.int64)
    bits = np.stack([u & np.uint64(SEGMENT_BITS - 1), (u >> np.uint64(20)) & np.uint64(SEGMENT_BITS - 1)], 1).astype(np.int64)
    return segment, bits


def _bitmap(bits: np.ndarray) -> np.ndarray:
    out = np.zeros(SEGMENT_BITS, np.uint8)
    out[bits.ravel()] = 1
    return np.packbits(out)


def repeat_filter(hashes: DataFrame, segments: int, least: int = 2) -> dict[int, np.ndarray]:
    """Segment -> bits seen again (with least 1, seen at all), eight to a byte, of a DataFrame with one long column h."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b["h"].to_numpy() for b in batches]
        if not parts:
            return
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        segment, bits = _places(h, segments)
        order = np.argsort(segment, kind="stable")
        segment, bits, n = segment[order], bits[order], n[order]
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(segment) else []
        for a, b in zip(starts, [*starts[1:], len(segment)], strict=True):
            yield pd.DataFrame({"segment": [segment[a]], "seen": [zstandard.compress(_bitmap(bits[a:b]).tobytes(), 1)], "again": [zstandard.compress(_bitmap(bits[a:b][n[a:b] >= least]).tobytes(), 1)]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        seen, again = np.zeros(SEGMENT_BITS // 8, np.uint8), np.zeros(SEGMENT_BITS // 8, np.uint8)
        for s, a in zip(rows["seen"], rows["again"], strict=True):
            s = np.frombuffer(zstandard.decompress(s), np.uint8)
            again |= np.frombuffer(zstandard.decompress(a), np.uint8) | (seen & s)
            seen |= s
        return pd.DataFrame({"segment": rows["segment"][:1], "again": [zstandard.compress(again.tobytes(), 1)]})

    partials = hashes.mapInPandas(partial, "segment long, seen binary, again binary")
    merged = partials.groupBy("segment").applyInPandas(merge, "segment long, again binary")
    with small_batches(hashes.sparkSession):
        return {r["segment"]: np.frombuffer(zstandard.decompress(r["again"]), np.uint8) for r in merged.collect()}  # at most `segments` rows


def repeat_test(hashes: DataFrame, rows: int, least: int = 2) -> Callable[[np.ndarray], np.ndarray]:
    """A function for use in tasks: of hashes, which are maybe repeated. True for every hash that occurs twice in `hashes` (with least 1, once), false for nearly all others."""
    segments = int(min(MAX_SEGMENTS, max(1, -(-rows * BITS_PER_ROW // SEGMENT_BITS))))
    held = hashes.sparkSession.sparkContext.broadcast(repeat_filter(hashes, segments, least))

    def test(h: np.ndarray) -> np.ndarray:
        segment, bits = _places(h, segments)
        out = np.zeros(len(h), bool)
        for s in np.unique(segment):
            if s in held.value:
                own, packed = segment == s, held.value[s]
                b = bits[own]
                out[own] = (((packed[b >> 3] >> (7 - (b & 7))) & 1) == 1).all(1)
        return out

    return test


def as_column(test: Callable[[np.ndarray], np.ndarray]) -> Column:
    """repeat_test() of the column h. A stage that has other Python work should test there instead, as each Python step of a task has a worker of its own."""
    return F.pandas_udf(lambda h: pd.Series(test(h.to_numpy())), "boolean")("h")


def maybe_repeated(hashes: DataFrame, rows: int) -> Column:
    return as_column(repeat_test(hashes, rows))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their normalised texts are; null counts as empty, so null and empty texts form one group. The row with the smallest doc_id
    stays; a null doc_id counts as the largest; of rows that also share the doc_id, one stays. Empty tables give empty results; other columns are not read.
    """
    sha = F.sha2(normalised(F.col("text")), 256)
    digests = saved(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), sha.alias("text_sha256")).withColumn("h", F.xxhash64("text_sha256")).withColumn("uid", F.monotonically_increasing_id()),
        "exact-digests",
    )
    flagged = saved(digests.withColumn("maybe", maybe_repeated(digests.select("h"), digests.count())), "exact-flagged")
    once = flagged.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    rows = flagged.filter("maybe")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    groups = saved(rows.groupBy("text_sha256").agg(first, F.count(F.lit(1)).alias("group_size")), "exact-groups")  # so that the join below can split a hot group
    again = rows.join(groups, "text_sha256").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), "text_sha256")
    return once.unionByName(again)


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_duplicates() drops, all columns kept, whatever their names. Rows whose hash occurs once pass straight through.

    Of rows that also share the smallest doc_id one stays, chosen by a hash of the row. Null texts are empty, null doc_ids the largest; empty tables stay empty.
    """
    sha = F.sha2(normalised(F.col("row.text")), 256)
    hashed = named_row(docs).withColumn("sha", sha).withColumn("h", F.xxhash64("sha"))
    hashes = saved(hashed.select("h"), "exact-hashes")
    flagged = hashed.withColumn("maybe", maybe_repeated(hashes, hashes.count()))
    once = flagged.filter(~F.col("maybe")).select("row")
    order = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.xxhash64("row"))
    again = flagged.filter("maybe").groupBy("sha").agg(F.min_by("row", order).alias("row")).select("row")
    return unnamed_row(once.unionByName(again), docs.columns)
