"""A trie of all conversations by their turns, built by distributed radix partitioning from the first turn on, and multikey quicksort within small buckets.

Turns are numbered by a dictionary of the distinct (role, text). Conversations with the same turns are one class from there on, told by 128 bits of hash over their
places and turns, so that copies cost nothing. Each round deals the classes of every large bucket by their turn at the bucket's depth; a bucket is a node
of the trie, named by its smallest conversation and its depth. A bucket of one class is a chain, whose nodes are made by plain columns, however long it is. A bucket
of at most `local` turns and classes goes to one task, where multikey quicksort emits its nodes. Larger ones are dealt again; there are as many rounds
as such a bucket is deep. What a node sums over its subtree is added up from the buckets, level by level, as their parents are few.

No task holds more than a bucket: turns are placed in their conversation by ranges of the whole order, joins by a conversation are by blocks of its turns, and
in joins by turn or bucket the keys with more than one HOT-th of the rows are broadcast, of which there are at most HOT.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from walflow.llm.common import dropped, saved

LOCAL, BLOCK, HOT = 50_000, 20_000, 4096
IDS_AT_ONCE = 10_000
NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end long, ended boolean, top boolean"
NOTHING = hashlib.sha256(b"").hexdigest()


def _by_block(rows: DataFrame, of: DataFrame, name: str = "conv_id") -> DataFrame:
    """rows (name, pos, ...) with the columns of `of`, which has a row a conversation with its number of turns, len."""
    many = of.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("len")) / BLOCK))))
    return rows.withColumn("_block", F.floor(F.col("pos") / BLOCK)).join(many, [name, "_block"]).drop("_block")


def _by_key(rows: DataFrame, of: DataFrame, on: list[str], times: str, total: int) -> DataFrame:
    """rows with the columns of `of`, which has each key once and in `times` how many of the `total` rows have it."""
    often = F.col(times) * HOT > total
    few = F.broadcast(of.filter(often).drop(times))
    return rows.join(few, on).unionByName(rows.join(few.select(*on), on, "left_anti").join(of.filter(~often).drop(times), on))


def placed_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each turn as conv_id, pos (from 0), id, words (saved), and each conversation as conv_id, len (saved).

    Turns are ordered by turn, null first, and where that is equal by role and text; null role and text are empty. Rows without conv_id take no part.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    given = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text")).filter("conv_id is not null").withColumn("uid", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "text", "uid"]
    ordered = given.repartitionByRange(*order).sortWithinPartitions(*order)
    key = lambda seed: F.xxhash64(F.lit(seed), "role", "text").alias(f"k{seed}")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    rows = saved(ordered.select("conv_id", key(1), key(2), words, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("uid")), "trie-turns")
    bounds = rows.groupBy("conv_id", "part").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = saved(bounds.withColumn("before", before), "trie-bounds")
    pos = (F.col("uid") - F.col("first") + F.col("before")).alias("pos")
    at = rows.join(bounds, ["conv_id", "part"]).select("conv_id", pos, "k1", "k2", "words")
    dictionary = saved(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times")).withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    coded = saved(_by_key(at, dictionary, ["k1", "k2"], "times", rows.count()).select("conv_id", "pos", "id", "words"), "trie-coded")
    convs = saved(bounds.groupBy("conv_id").agg(F.sum("n").alias("len")), "trie-conversations")
    for done in (rows, bounds, dictionary):
        dropped(done)
    return coded, convs


def shared_openings(rows: DataFrame, convs: DataFrame, base: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first `taken` turns (at most `most`) of the conversation `base`, all if it has fewer, and go on behind as many of their own."""
    head = rows.filter(F.col("pos") < most).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "words"))).alias("head"))
    asked = convs.select("conv_id", "len", base.alias("base"), taken.alias("taken"))
    opened = saved(asked.join(head, "base", "left").withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("taken")), F.array().cast("array<struct<pos:bigint,id:bigint,words:bigint>>"))), "trie-openings")
    own = _by_block(rows, opened.select("conv_id", "len", "taken", F.size("head").alias("got"))).filter("pos >= taken").select("conv_id", (F.col("pos") - F.col("taken") + F.col("got")).alias("pos"), "id", "words")
    lent = opened.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.id", "t.words")
    size = F.size("head") + F.greatest(F.col("len") - F.col("taken"), F.lit(0))
    return saved(own.unionByName(lent), "trie-rebuilt"), saved(opened.select("conv_id", size.cast("long").alias("len")), "trie-rebuilt-conversations")


def _ends(members: DataFrame) -> DataFrame:
    """end (the smallest conv_id of a class), ends_sha256: over all conv_ids of the class in numeric order. members: conv_id, x1, x2, len.

    The whole order is dealt by ranges and its ids joined into chunks; only a class that goes over a partition's edge, or is large, is put together from its chunks.
    """
    keys = ["x1", "x2", "len"]

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, ids, edge = None, [], True

        def row(whole: bool) -> tuple:
            return (*last, ids[0], ",".join(map(str, ids)), whole)

        for batch in batches:
            rows = []
            for *key, conv in batch[[*keys, "conv_id"]].itertuples(index=False, name=None):
                if key != last and last is not None:
                    rows.append(row(not edge))
                    ids, edge = [], False
                elif len(ids) >= IDS_AT_ONCE:
                    rows.append(row(False))
                    ids, edge = [], True
                last = key
                ids.append(conv)
            yield pd.DataFrame(rows, columns=[*keys, "first", "ids", "whole"])
        if ids:
            yield pd.DataFrame([row(False)], columns=[*keys, "first", "ids", "whole"])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, first, sha = None, 0, hashlib.sha256()
        for batch in batches:
            rows = []
            for *key, begins, ids in batch[[*keys, "first", "ids"]].itertuples(index=False, name=None):
                if key != last:
                    if last is not None:
                        rows.append((first, sha.hexdigest()))
                    last, first, sha = key, begins, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(rows, columns=["end", "ends_sha256"])
        if last is not None:
            yield pd.DataFrame([(first, sha.hexdigest())], columns=["end", "ends_sha256"])

    order = [*keys, "conv_id"]
    found = saved(members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(chunks, "x1 long, x2 long, len long, first long, ids string, whole boolean"), "trie-chunks")
    rest = found.filter("not whole").drop("whole").repartition(*keys).sortWithinPartitions(*keys, "first").mapInPandas(digests, "end long, ends_sha256 string")
    return found.filter("whole").select(F.col("first").alias("end"), F.sha2("ids", 256).alias("ends_sha256")).unionByName(rest)


def _bucket_nodes(top: tuple[int, int, int], classes: list[tuple[int, int, int, int]], ids: list[int], words: list[int]) -> list[list]:
    """The nodes of a bucket, as NODE. top: its depth, its parent's smallest conversation, the words of its last turn.

    classes: (smallest conversation, conversations, first place in ids and words, turns there), which are the turns behind the bucket's depth.
    """
    depth, parent, w = top
    nodes: list[list] = []
    above: list[int] = []
    weight: list[int] = []

    def node(members: list[int], at: int, up: int, w: int) -> int:
        low, n = min(classes[m][0] for m in members), sum(classes[m][1] for m in members)
        nodes.append([low, depth + at, nodes[up][0] if up >= 0 else parent, n, 0, 0, (n - 1) * w, 0, False, up < 0])
        above.append(up)
        weight.append(w)
        return len(nodes) - 1

    every = list(range(len(classes)))
    todo = [(every, 0, node(every, 0, -1, w), True)]
    while todo:  # classes below the node `up` that agree in their first `at` turns; new: whether one of them may end there
        members, at, up, new = todo.pop()
        if new:
            for m in members:
                if classes[m][3] == at:
                    nodes[up][7:9] = [classes[m][0], True]
            members = [m for m in members if classes[m][3] > at]
        if not members:
            continue
        key = {m: ids[classes[m][2] + at] for m in members} if len(members) > 1 else {members[0]: 0}
        pivot = key[members[len(members) // 2]]
        less, same, more = ([m for m in members if key[m] < pivot], [m for m in members if key[m] == pivot], [m for m in members if key[m] > pivot])
        for part in (less, more):
            if part:
                todo.append((part, at, up, False))
        nodes[up][4] += 1
        todo.append((same, at + 1, node(same, at + 1, up, words[classes[same[0]][2] + at]), True))
    for k in range(len(nodes) - 1, -1, -1):
        x, up = nodes[k], above[k]
        x[5] = x[5] or 1
        if up >= 0:
            nodes[up][5] += x[5]
            nodes[up][6] += x[6]
    return nodes


def _local_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows bucket, depth, parent, above (words), conv_id, n, pos, id, words in order of bucket, depth, conv_id, pos; pos -1 stands for a class itself."""
    bucket, classes, ids, words = None, [], [], []

    def nodes() -> list[list]:
        return _bucket_nodes(bucket[1:], [(c, n, a, b - a) for (c, n, a), b in zip(classes, [x[2] for x in classes[1:]] + [len(ids)], strict=True)], ids, words)

    for batch in batches:
        out = []
        for name, depth, parent, above, conv, n, pos, i, w in batch.itertuples(index=False, name=None):
            if bucket is None or name != bucket[0] or depth != bucket[1]:
                if bucket:
                    out += nodes()
                bucket, classes, ids, words = (name, depth, parent, above), [], [], []
            if pos < 0:
                classes.append((conv, n, len(ids)))
            else:
                ids.append(i)
                words.append(w)
        yield pd.DataFrame(out, columns=_NODE_NAMES)
    if bucket:
        yield pd.DataFrame(nodes(), columns=_NODE_NAMES)


_NODE_NAMES = [c.split()[0] for c in NODE.split(", ")]


def _chain_nodes(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """The nodes of buckets with a single class. chains: conv_id, depth, parent, n, len; rows: conv_id, pos, words."""
    x = _by_block(rows.select("conv_id", "pos", "words"), chains).filter("pos >= depth - 1").withColumn("block", F.floor(F.col("pos") / BLOCK))
    later = x.groupBy("conv_id", "block").agg(F.sum("words").alias("sum")).withColumn("later", F.coalesce(F.sum("sum").over(Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    here = F.sum("words").over(Window.partitionBy("conv_id", "block").orderBy(F.desc("pos")))
    x = x.withColumn("here", here).join(later.select("conv_id", "block", "later"), ["conv_id", "block"])
    at, last = F.col("pos") + 1, F.col("pos") + 1 == F.col("len")
    return x.select(
        "conv_id", at.cast("int").alias("depth"), F.when(at == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"), (~last).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * (F.col("here") + F.col("later"))).alias("saved_tokens"), F.col("conv_id").alias("end"), last.alias("ended"), (at == F.col("depth")).alias("top"),
    )


def trie_nodes(rows: DataFrame, convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie of turns (conv_id, pos, id, words) placed gapless from 0, of the conversations (conv_id, len): see prefix_trie()."""
    pair = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "pos", "id")).alias(f"x{seed}")
    zero = F.lit(0).cast("long")
    hashed = rows.groupBy("conv_id").agg(pair(1), pair(2)).unionByName(convs.filter("len = 0").select("conv_id", zero.alias("x1"), zero.alias("x2")))
    members = saved(hashed.join(convs, "conv_id"), "trie-members")
    classes = saved(members.groupBy("x1", "x2", "len").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).select("conv_id", "n", "len"), "trie-classes")
    turns = saved(_by_block(rows, classes), "trie-class-turns")  # conv_id, pos, id, words, n, len
    whole = classes.agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    level = classes.limit(0).select("conv_id", zero.cast("int").alias("depth"), zero.alias("parent"), "n", zero.alias("words"))
    if whole["k"]:
        level = classes.sparkSession.createDataFrame([(whole["conv_id"], 0, 0, whole["n"], 0)], level.schema)
    upper, lower = [saved(level, "trie-upper")], []
    active, depth = classes.withColumn("bucket", F.lit(whole["conv_id"]).cast("long")), 0
    at_end: list[DataFrame] = []
    while active is not None:
        at_end.append(active.filter(F.col("len") == depth).select(F.col("bucket").alias("conv_id"), F.lit(depth).alias("depth"), F.col("conv_id").alias("end")))
        going = active.select("conv_id", "bucket").join(turns.filter(F.col("pos") == depth), "conv_id")
        groups = going.groupBy("bucket", "id").agg(F.min("conv_id").alias("child"), F.sum("n").alias("convs"), F.count(F.lit(1)).alias("k"), F.sum(F.col("len") - depth).alias("size"), F.first("words").alias("words"))
        groups = saved(groups.withColumn("kind", F.when(F.col("k") == 1, "chain").when(F.col("size") <= local, "local").otherwise("large")), f"trie-groups-{depth}")
        to = groups.select("bucket", "id", "child", "kind", F.col("words").alias("above"), "k")
        dealt = saved(_by_key(going.select("conv_id", "bucket", "id", "n", "len"), to, ["bucket", "id"], "k", whole["k"]), f"trie-dealt-{depth}")
        depth += 1
        at = F.lit(depth).alias("depth")
        lower.append(_chain_nodes(turns, dealt.filter("kind = 'chain'").select("conv_id", at, F.col("bucket").alias("parent"), "n", "len")))
        small = dealt.filter("kind = 'local'").select("child", at, F.col("bucket").alias("parent"), "above", "conv_id", "n", "len")
        inner = _by_block(turns.select("conv_id", "pos", "id", "words").filter(F.col("pos") >= depth), small)
        cols = ["child", "depth", "parent", "above", "conv_id", "n", "pos", "id", "words"]
        met = small.select(*cols[:6], F.lit(-1).cast("long").alias("pos"), zero.alias("id"), zero.alias("words")).unionByName(inner.select(*cols))
        lower.append(met.repartition("child", "depth").sortWithinPartitions("child", "depth", "conv_id", "pos").mapInPandas(_local_nodes, NODE))
        large = groups.filter("kind = 'large'")
        active = None
        if large.head(1):
            upper.append(saved(large.select(F.col("child").alias("conv_id"), at, F.col("bucket").alias("parent"), F.col("convs").alias("n"), "words"), "trie-upper"))
            active = dealt.filter("kind = 'large'").select("conv_id", "n", "len", F.col("child").alias("bucket"))
    below = saved(reduce(DataFrame.unionByName, lower), "trie-lower")
    ends = reduce(DataFrame.unionByName, at_end)
    tops, out = below.filter("top").select("parent_conv_id", "depth", "n_leaves", "saved_tokens"), [below]
    for k in range(len(upper) - 1, -1, -1):
        sums = tops.filter(F.col("depth") == k + 1).groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("tokens"))
        own = upper[k].join(sums, "conv_id", "left").join(ends.filter(F.col("depth") == k).select("conv_id", "end"), "conv_id", "left")
        full = saved(own.select(
            "conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"), F.coalesce("leaves", zero + 1).alias("n_leaves"),
            ((F.col("n") - 1) * F.col("words") + F.coalesce("tokens", zero)).alias("saved_tokens"), F.coalesce("end", zero).alias("end"), F.col("end").isNotNull().alias("ended"), F.lit(False).alias("top"),
        ), "trie-level")
        tops = tops.unionByName(full.select("parent_conv_id", "depth", "n_leaves", "saved_tokens"))
        out.append(full)
    nodes = reduce(DataFrame.unionByName, out).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return nodes.filter("ended").join(_ends(members), "end").select(*cols).unionByName(nodes.filter("not ended").withColumn("ends_sha256", F.lit(NOTHING)).select(*cols)).withColumn("depth", F.col("depth").cast("long"))


def prefix_trie(conversations: DataFrame, rebuilt: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None, local: int = LOCAL) -> DataFrame:
    """One row per node of the trie of conversations (conv_id, turn, role, text): conv_id (its smallest conversation), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over its subtree, the words of each node's last turn times all its conversations but one), ends_sha256 (of the conversations that end there).

    Turns are ordered by turn, null first, then by role and text; null role and text are empty, and repeated rows are turns of their own. Rows without conv_id take no
    part. An empty table gives no nodes, not even a root. Words are stretches without ASCII white space. Other columns are not read. rebuilt, if given, changes
    the placed turns and conversations first (see shared_openings()). local: the most turns and classes of a bucket that one task finishes.
    """
    rows, convs = placed_turns(conversations)
    if rebuilt:
        rows, convs = rebuilt(rows, convs)
    return trie_nodes(rows, convs, local)
