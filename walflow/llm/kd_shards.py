"""Sharding by a k-d tree over document metadata, with DataFrame operations only.

A node that must yield m shards is split at the weighted quantile m//2 : m - m//2 of its bytes, along the metadata dimension in which it is widest,
until each leaf holds the target bytes. Medians come from weighted_cuts(): sums over at most 4096 bins a node and round, so neither rows nor sorts
pass through one task. The tree has fewer than 2 * shards nodes; only these bounds and cut points reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walflow.llm.common import by_node, numbered, saved, weighted_cuts

ROW_BYTES = 16
COORD_BITS, TIE_BITS = 20, 28
DIMENSIONS = ("source", "lang", "size", "age")


def _prefix(text: str) -> Column:
    """The first six bytes of a string as a number, in the order of the strings; null is 0."""
    return F.coalesce(F.conv(F.hex(F.rpad(F.substring(F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8"), 1, 6), 6, F.unhex(F.lit("00")))), 16, 10).cast("double"), F.lit(0.0))


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the four coordinates, each a whole number below 2**20 scaled to the table's range; tie: 28 hash bits of the row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    have = {c.lower() for c in docs.columns}
    raw = saved(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            *[(_prefix(c) if c in have else F.lit(0.0)).alias(f"d_{c}") for c in ("source", "lang")],
        ).withColumn("uid", F.monotonically_increasing_id()).withColumns({"d_size": F.log2("size"), "d_age": F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)), "tie": F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "uid"), 64 - TIE_BITS)}),
        "kd-metadata",
    )
    span = raw.agg(*[f(f"d_{d}").alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = {}
    for d in DIMENSIONS:
        lo, hi = span[f"lo_{d}"] or 0.0, span[f"hi_{d}"] or 0.0
        scaled[f"c_{d}"] = F.floor((F.col(f"d_{d}") - lo) / (hi - lo) * (2**COORD_BITS - 1)).cast("long") if hi > lo else F.lit(0).cast("long")
    return raw.withColumns(scaled)


def kd_tree(rows: DataFrame, shards: int) -> tuple[DataFrame, Column]:
    """The rows of metadata() with their leaf, and the shard of each row as an expression over it."""
    node, leaves = F.lit(0).cast("long"), {0: (0, shards)}  # node -> first shard, number of shards
    while any(n > 1 for _, n in leaves.values()):
        here = rows.withColumn("node", node)
        box = here.groupBy("node").agg(F.sum("size").alias("bytes"), *[(F.max(f"c_{d}") - F.min(f"c_{d}")).alias(d) for d in DIMENSIONS]).collect()
        axis = {r["node"]: max(range(len(DIMENSIONS)), key=lambda i, r=r: (r[DIMENSIONS[i]], -i)) for r in box}
        size = {r["node"]: r["bytes"] for r in box}
        open_nodes = {k: v for k, v in leaves.items() if v[1] > 1 and k in size}
        at = F.coalesce(*[F.when(by_node(axis, F.col("node")) == i, F.col(f"c_{d}")) for i, d in enumerate(DIMENSIONS)], F.lit(0))
        key = F.shiftleft(at.cast("long"), TIE_BITS) + F.col("tie")
        cuts = weighted_cuts(here, F.col("node"), key, F.col("size"), {k: max(1, size[k] * (n // 2) // n) for k, (_, n) in open_nodes.items()}, COORD_BITS + TIE_BITS)
        grown, new = {}, node
        for k, (lo, n) in leaves.items():
            if k not in open_nodes:
                grown[k] = (lo, 1)
                continue
            cut, below, own = cuts[k]
            want = size[k] * (n // 2) / n
            limit = cut + 1 if abs(below + own - want) <= abs(below - want) else cut  # the row on the line goes where it unbalances less
            left, right = max([*leaves, *grown]) + 1, max([*leaves, *grown]) + 2
            coord = F.col(f"c_{DIMENSIONS[axis[k]]}").cast("long")
            new = F.when(node == k, F.when(F.shiftleft(coord, TIE_BITS) + F.col("tie") < limit, F.lit(left).cast("long")).otherwise(F.lit(right).cast("long"))).otherwise(new)
            grown[left], grown[right] = (lo, n // 2), (lo + n // 2, n - n // 2)
        node, leaves = new, grown
        rows = saved(rows.withColumn("_node", node), "kd-nodes").withColumn("node", F.col("_node")).drop("_node")
        node = F.col("node")
    first = {k: lo for k, (lo, _) in leaves.items()}
    return rows, by_node(first, node, 0)


def kd_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law = 'bytes', shard from 0, slot (gapless from 0 in each shard), grown_shard = null.

    Null text has no bytes; null metadata sorts lowest; rows alike in all metadata are split by a hash of the row, so one hot source or group of
    copies spreads over as many shards as its bytes need. Empty tables give empty results; other columns are not read.
    """
    rows, shard = kd_tree(metadata(docs), shards)
    placed = numbered(rows.withColumn("shard", shard.cast("int")), "shard", F.col("tie"), [F.col("doc_id"), F.col("uid")], "slot", groups=shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
