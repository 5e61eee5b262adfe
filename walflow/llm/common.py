"""What the corpus operators share: tables in the shared folder, distributed cut points, gapless numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and bytes that go to a Python worker at once while a table is made here, as rows may hold whole texts or sets, and the bytes of a row group in a file.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
FILE_BLOCK = 16 << 20

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode without that setting."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-walflow-"))
    return f"file://{_own_folder[0]}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs within send batches of bounded rows and bytes to Python workers; the session's settings come back after them."""
    before = {k: spark.conf.get(k) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: later stages survive lost executors, and nothing runs twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("parquet.block.size", FILE_BLOCK).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by saved() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        if folder.toString().replace("file:", "").startswith(shared_folder(spark).replace("file://", "")):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def quoted(name: str) -> str:
    """A column's name as it must be written where names may hold dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def named_row(docs: DataFrame) -> DataFrame:
    """docs as one column `row`, so that no name in docs meets another."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))


def unnamed_row(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("row")[c].alias(c) for c in columns])


def with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of `row` with text from the column `new`, and n_chars, if there is such a column, to match."""
    new = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return rows.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in columns])


def whole_id(docs: DataFrame) -> list[Column]:
    """doc_id without nulls and, as no_id, where there was none, for steps in Python: pandas turns whole numbers beside a null into floats, which tell no ids above 2**53 apart."""
    given = docs["doc_id"].cast("long")
    return [F.coalesce(given, F.lit(0).cast("long")).alias("doc_id"), given.isNull().alias("no_id")]


def own_id(rows: DataFrame) -> DataFrame:
    """rows with the doc_ids that whole_id() made, null again where there was none."""
    return rows.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def lower_az(text: Column) -> Column:
    """A-Z to a-z and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_node(values: dict[int, int], node: Column, default: int = -1) -> Column:
    """A CASE over the few nodes of a tree."""
    return reduce(lambda c, kv: F.when(node == kv[0], F.lit(kv[1]).cast("long")).otherwise(c), values.items(), F.lit(default).cast("long"))


def weighted_cuts(df: DataFrame, node: Column, key: Column, weight: Column, targets: dict[int, int], bits: int, step: int = 12) -> dict[int, tuple[int, int, int]]:
    """For each node, the smallest key at which the running weight, in order of key, reaches the node's target.

    Keys are whole numbers from 0 up to 2**bits. Each round fixes `step` more bits: the weights of at most 2**step bins a node are summed with
    map-side combine, and one row a node comes back. Returns node -> (key, weight below it, weight at it). The exact answer, without a sort of the rows.
    """
    prefix, below = dict.fromkeys(targets, 0), dict.fromkeys(targets, 0)
    at: dict[int, int] = {}
    left = bits
    rows = df.select(node.cast("long").alias("node"), key.cast("long").alias("key"), weight.cast("long").alias("w")).filter(F.col("node").isin(list(targets)))
    while left > 0:
        now = min(step, left)
        left -= now
        n = F.col("node")
        inside = rows if not at else rows.filter(F.shiftright("key", left + now) == by_node(prefix, n))
        bins = inside.groupBy("node", F.shiftright("key", left).alias("bin")).agg(F.sum("w").alias("w"))
        run = F.sum("w").over(Window.partitionBy("node").orderBy("bin")) + by_node(below, n, 0)
        found = bins.withColumn("run", run).filter(F.col("run") >= by_node(targets, n)).groupBy("node").agg(F.min(F.struct("bin", "run", "w")).alias("x")).collect()
        for r in found:
            prefix[r["node"]], at[r["node"]] = r["x"]["bin"], r["x"]["w"]
            below[r["node"]] = r["x"]["run"] - r["x"]["w"]
    return {k: (prefix[k], below[k], at[k]) for k in at}


def numbered(df: DataFrame, group: str, spread: Column, order: list[Column], name: str, per_block: int = 20_000, groups: int = 1) -> DataFrame:
    """df with column `name`: 0, 1, 2, ... within each group, in blocks of about per_block rows so that no task holds a whole group.

    spread: an evenly spread whole number below 2**28 that leads the order. groups: how many groups there are at least.
    """
    blocks = max(1, df.count() // max(1, per_block * groups))
    cut = df.withColumn("_block", F.floor(spread.cast("double") * blocks / 2**28).cast("long"))
    before = (
        cut.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
        .select(F.col(group).alias("_g"), F.col("_block").alias("_b"), F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    own = F.row_number().over(Window.partitionBy(group, "_block").orderBy(spread, *order)) - 1
    placed = cut.withColumn("_own", own)
    joined = placed.join(before, (placed[group].eqNullSafe(before["_g"])) & (placed["_block"] == before["_b"]))
    return joined.withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_block", "_own", "_before", "_g", "_b")


def group_pairs(rows: DataFrame, keys: list[str], order: list[str], passing: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """passing(rows, group numbers) over all rows of each group, many whole groups at a time: rows are dealt and sorted by keys and streamed.

    Only the group at the end of a batch waits for the next one, so groups should be bounded (see blocks()).
    """

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            k = batch[keys].to_numpy()
            last = (k == k[-1]).all(1)
            if held and (held[0][keys].iloc[0].to_numpy() == k[0]).all() and last.all():
                held.append(batch)
                continue
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            yield from found(pd.concat([*held, batch.iloc[:cut]], ignore_index=True))
            held = [batch.iloc[cut:]]
        if held:
            yield from found(pd.concat(held, ignore_index=True))

    def found(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(x) > 1:
            k = x[keys].to_numpy()
            yield passing(x, np.cumsum(np.r_[True, (k[1:] != k[:-1]).any(1)]))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(meet, schema)


def blocks(rows: DataFrame, key: str, member: str, most: int, check: int = 10_000) -> DataFrame:
    """rows with lo, hi: keys with over `most` rows are cut into blocks, and each pair of blocks is a group of its own.

    The heavy keys are broadcast if there are at most `check` of them, else joined by shuffle.
    """
    heavy = saved(rows.groupBy(key).count().filter(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("_blocks")), "heavy-keys")
    zero = F.lit(0)
    if not heavy.head(1):
        return rows.withColumn("lo", zero).withColumn("hi", zero)
    met = rows.join(F.broadcast(heavy) if heavy.count() <= check else heavy, key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    own, other = F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"), F.explode(F.sequence(zero, F.col("_blocks") - 1))
    placed = met.withColumn("_own", own).withColumn("_other", other)
    return placed.withColumn("lo", F.least("_own", "_other")).withColumn("hi", F.greatest("_own", "_other")).drop("_own", "_other", "_blocks")
