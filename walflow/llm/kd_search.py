"""Exact top-k search by inner product with a k-d tree per shard.

Vectors are dealt to shards of bounded size. Each shard's tree splits at the median of its widest dimension and keeps the tight bounding box of every
node. A query walks a tree best first: a box cannot score above the sum of its better corner in each dimension, and a box below the k-th score so far is
never opened. Each query first visits one shard; its k-th score there goes along to all the others. Queries meet trees in blocks of bounded size.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from walflow.llm.common import saved

SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 16_384, 2_048, 256


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """vec_id, dim, vec: floor(1024 x) as 64-bit numbers; vectors that are null or hold null or non-finite components go."""
    for batch in batches:
        ids, dims, vecs = [], [], []
        for i, e in zip(batch["vec_id"], batch["embedding"], strict=True):
            if e is None or i is None or pd.isna(i):
                continue
            x = np.asarray([np.nan if v is None else v for v in e], np.float64) if getattr(e, "dtype", None) == object or isinstance(e, list) else np.asarray(e, np.float64)
            if not np.isfinite(x).all():
                continue
            y = np.floor(1024 * x)
            if len(y) and np.abs(y).max() >= 2.0**62:
                raise ValueError(f"vec_id {i}: a component times 1024 does not fit 64 bits")
            ids.append(int(i))
            dims.append(len(y))
            vecs.append(y.astype(np.int64).tobytes())
        yield pd.DataFrame({"vec_id": pd.Series(ids, dtype="int64"), "dim": pd.Series(dims, dtype="int32"), "vec": pd.Series(vecs, dtype=object)})


class Tree:
    """Median splits of integer vectors; node boxes lo, hi; leaves hold slices of the reordered vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.arange(len(ids))
        self.lo, self.hi, self.kids, self.slices = [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            part = x[order[a:b]]
            node = len(self.kids)
            self.lo.append(part.min(0))
            self.hi.append(part.max(0))
            self.kids.append([-1, -1])
            self.slices.append((a, b))
            if parent >= 0:
                self.kids[parent][side] = node
            wide = self.hi[-1] - self.lo[-1]
            if b - a > LEAF_ROWS and wide.size and wide.max() > 0:
                d, mid = int(wide.argmax()), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, d], mid)]
                todo += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
        self.ids, self.x = ids[order], x[order]
        self.lo, self.hi = np.stack(self.lo), np.stack(self.hi)
        self.most = int(np.abs(x).max()) if x.size else 0

    def search(self, query: int, q: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """(score, vec_id) of the k best rows that are not the query's own and not below `least`."""
        small = max(1, len(q)) * self.most * int(np.abs(q).max() if len(q) else 0) < 2**53
        kind = np.float64 if small else object  # exact either way
        qk = q.astype(kind)
        bound = np.maximum(self.lo.astype(kind) * qk, self.hi.astype(kind) * qk).sum(1) if len(q) else np.zeros(len(self.kids))
        best: list[tuple[int, int]] = []  # heap of (score, -vec_id)
        heap = [(-bound[0], 0)]
        while heap:
            up, node = heapq.heappop(heap)
            floor = best[0][0] if len(best) == k else least
            if floor is not None and -up < floor:
                break
            if self.kids[node][0] >= 0:
                for c in self.kids[node]:
                    if floor is None or bound[c] >= floor:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            a, b = self.slices[node]
            s = self.x[a:b].astype(kind) @ qk if len(q) else np.zeros(b - a)
            ok = self.ids[a:b] != query
            if floor is not None:
                ok &= s >= floor
            s, ids = s[ok], self.ids[a:b][ok]
            for j in np.lexsort((ids, -s))[:k] if small else sorted(range(len(s)), key=lambda j: (-s[j], ids[j]))[:k]:
                x = (int(s[j]), -int(ids[j]))
                if len(best) < k:
                    heapq.heappush(best, x)
                elif x > best[0]:
                    heapq.heapreplace(best, x)
        return [(s, -i) for s, i in best]


def _plant(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    dim = int(rows["dim"].iloc[0])
    x = np.frombuffer(b"".join(rows["vec"]), np.int64).reshape(len(rows), dim)
    return pd.DataFrame({"dim": [dim], "shard": [key[1]], "tree": [pickle.dumps(Tree(rows["vec_id"].to_numpy(), x))]})


def _visits(trees: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """queries (dim, shard, block, vec_id, vec, least) against their shard's tree."""

    def walk(tree: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(tree) and len(own):
            t = pickle.loads(tree["tree"].iloc[0])
            for i, v, least in zip(own["vec_id"], own["vec"], own["least"], strict=True):
                out += [(i, x, s) for s, x in t.search(int(i), np.frombuffer(v, np.int64), k, int(least))]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    blocks = queries.groupBy(F.col("dim").alias("d"), F.col("shard").alias("s"), F.col("block").alias("b")).count()
    lent = trees.join(blocks, (trees["dim"] == F.col("d")) & (trees["shard"] == F.col("s"))).select("d", "s", "b", "tree")
    return lent.groupBy("d", "s", "b").cogroup(queries.groupBy("dim", "shard", "block")).applyInPandas(walk, "query_id long, vec_id long, score long")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k best inner products of each row whose vec_id is divisible by `every`, ties to the smaller vec_id.

    Components are floor(1024 x). Vectors null or with null or non-finite components, and rows without vec_id, take no part; vectors of different length are
    never compared. A query's own rows are those with its vec_id; repeated rows of other vec_ids are each a candidate, those of a query one query. A score
    that does not fit 64 bits is an error. Empty tables give empty results; other columns are not read.
    """
    rows = saved(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null").mapInPandas(_whole, "vec_id long, dim int, vec binary").withColumn("uid", F.monotonically_increasing_id()), "kd-vectors")
    sizes = saved(rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("shards")), "kd-sizes")
    placed = rows.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", "uid"), F.col("shards")))
    trees = saved(placed.groupBy("dim", "shard").applyInPandas(_plant, "dim int, shard long, tree binary"), "kd-trees")
    asked = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vec"]).drop("uid")
    count = F.lit(max(1, -(-asked.count() // QUERY_ROWS)))
    asked = asked.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), count)).withColumn("home", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("shards")))
    none = F.lit(-(2**63 - 1)).cast("long")  # a number, as pandas turns whole numbers beside a null into floats
    first = saved(_visits(trees, asked.withColumn("shard", F.col("home")).withColumn("least", none), k), "kd-first")
    kth = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).select("vec_id", F.when(F.col("n") >= k, F.col("s")).otherwise(none).alias("least"))
    rest = asked.join(kth, "vec_id", "left").withColumn("least", F.coalesce("least", none)).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).filter("shard <> home")
    hits = first.unionByName(_visits(trees, rest, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
