"""Exact Jaccard self-join of documents' word shingles by universe partition and the pigeonhole principle.

Two sets of a and b shingles with Jaccard similarity of at least 0.8 differ in at most D = (a + b) // 9 shingles. Shingle hashes are the universe; a size
band cuts it into segments. What a set holds in one segment is a segment subset, and D differences cannot touch more than D segments, so similar sets
share a segment subset. Each band has the allocation that costs fewer index entries (see band()):

depth 1: the subsets alone. Only non-empty subsets are indexed, and a set needs D + 1 of them in the segments that count for its size; a set with
    fewer (its segments came out empty by chance) is "thin" and is joined through its single shingles instead.
depth 2: half as many segments, each indexed by its subset and by every subset with one shingle deleted. Segments may then differ in one shingle.

Equal sets are one class; only class representatives are indexed. Rows of an index bucket are linked to the bucket's smallest class, one partner each is
verified first. Buckets whose members are then still in different components are compared in blocks, after exact bounds on sizes and on the parity bits of
both sets, in two rounds: the first makes no more pairs than would connect the components that meet in a batch of buckets, as a pair of near copies meets in
many buckets; the last makes all pairs of what is still apart. No link between different sets is lost; the pairs inside a group that is already connected
are never made.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from walflow.llm.common import blocks, dropped, group_pairs, named_row, own_id, saved, unnamed_row, whole_id
from walflow.llm.components import components
from walflow.llm.exact_dedup import as_column, repeat_test
from walflow.llm.words import in_parts, joined, word_hashes

WORDS = 5
LEAST_SET = 4  # smaller sets are at 0.8 only if equal
GROWTH = 1.6
LEAST_PARITY, MOST_PARITY = 512, 1 << 17
BLOCK = 1000
DOCS_AT_ONCE = 200


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word 5-grams; of all its words if it has fewer; nothing without words.

    A-Z are lower-cased, and words end at space, tab, line feed, vertical tab, form feed and carriage return.
    """
    out = []
    for _, some in in_parts([t or "" for t in texts]):
        whole, begins = joined(some)
        start, flat = word_hashes(whole)
        with np.errstate(over="ignore"):
            grams, mult = np.zeros(len(flat), np.uint64), np.uint64(0x9E3779B97F4A7C15)
            for k in range(WORDS):
                grams[: len(flat) - k] = grams[: len(flat) - k] * mult + flat[k:]
            grams = mixed(grams)
            at = np.searchsorted(start, np.r_[begins, len(whole)]).tolist()
            for a, b in zip(at, at[1:], strict=False):
                if b - a >= WORDS:
                    out.append(np.unique(grams[a : b - WORDS + 1]))
                elif b > a:
                    x = np.uint64(b - a)
                    for h in flat[a:b]:
                        x = x * mult + h
                    out.append(mixed(np.array([x], np.uint64)))
                else:
                    out.append(np.zeros(0, np.uint64))
    return out


@cache
def band(k: int) -> tuple[int, int, int, int]:
    """Of size band k: smallest and largest size, segments, depth.

    Depth 1 is taken where it needs fewer index entries for a middling set and fills its segments well enough that thin sets all but never occur.
    """
    low = LEAST_SET if k == 0 else band(k - 1)[1] + 1
    high = max(low, int(low * GROWTH))
    units = 2 * high // 9 + 1
    one = math.ceil(0.32 * high) + 8
    two = -(-units // 2)
    return (low, high, one, 1) if reach(low, low, one, high) <= one and reach(high, high, one, high) <= one and reach(high, high, one, high) < high + two else (low, high, two, 2)


def reach(size: int, own: int, segments: int, high: int) -> int:
    """How many of a band's segments count for a set of this size at depth 1: enough for D + 1 non-empty ones, with seven standard deviations to spare."""
    need = (size + min(high, size * 5 // 4)) // 9 + 1
    load = own / segments
    full = 1 - math.exp(-load)
    spare = 7 * math.sqrt(max(0.3, need * math.exp(-load) * full))
    return math.ceil((need + spare) / full)


def band_of(size: int) -> int:
    k = 0
    while band(k)[1] < size:
        k += 1
    return k


def entries(x: np.ndarray) -> tuple[np.ndarray, bool]:
    """Index entries of a sorted set, and whether it is thin."""
    size = len(x)
    if size < LEAST_SET:
        return np.zeros(0, np.uint64), False
    out, thin, k = [], False, band_of(size)
    with np.errstate(over="ignore"):
        for b in (k, k + 1) if size * 5 // 4 > band(k)[1] else (k,):
            _, high, m, depth = band(b)
            segment = ((x >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # grows with x
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            held, y = segment[starts], mixed(x ^ np.uint64(0x5851F42D4C957F2D))
            sums = np.add.reduceat(y, starts)
            key = np.uint64(b << 32)
            if depth == 1:
                counts = held < min(m, reach(size, size, m, high))
                out.append(mixed(mixed(sums[counts]) + (held[counts] | key)))
                thin |= int(counts.sum()) < (size + min(high, size * 5 // 4)) // 9 + 1
            else:
                every = np.zeros(m, np.uint64)
                every[held.astype(np.int64)] = sums
                out.append(mixed(mixed(every) + (np.arange(m, dtype=np.uint64) | key)))
                out.append(mixed(mixed(np.repeat(sums, np.diff(np.r_[starts, size])) - y) + (segment | key)))
    return np.unique(np.concatenate(out) & np.uint64((1 << 48) - 1)), thin


def parity(x: np.ndarray) -> bytes:
    """Bit i: whether an odd number of shingles falls on i, over as many bits as the set has shingles, rounded up to a power of two."""
    bits = min(MOST_PARITY, max(LEAST_PARITY, 1 << (len(x) - 1).bit_length() if len(x) else 0))
    return np.packbits((np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


class Parities:
    """Lower bounds on the differences of pairs of sets: the parity bits in which they differ, the wider one folded in half."""

    def __init__(self, parities: list[bytes]) -> None:
        self.width = np.array([len(p) for p in parities])
        self.at, self.bits = {}, {}
        for w in np.unique(self.width):
            own, wide = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            x = np.frombuffer(b"".join(parities[i] for i in own), np.uint64).reshape(len(own), int(w) // 8)
            y = np.frombuffer(b"".join(parities[i] for i in wide), np.uint64).reshape(len(wide), 2, int(w) // 8)
            self.at[w] = np.zeros(len(parities), np.int64)
            self.at[w][np.r_[own, wide]] = np.arange(len(own) + len(wide))
            self.bits[w] = np.concatenate([x, y[:, 0] ^ y[:, 1]])

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs whose sizes differ by a factor below two."""
        out, w = np.zeros(len(i), np.int64), np.minimum(self.width[i], self.width[j])
        for k in np.unique(w):
            for some in np.array_split(np.flatnonzero(w == k), max(1, len(i) * int(k) >> 25)):  # some 32 MB at a time
                out[some] = np.bitwise_count(self.bits[k][self.at[k][i[some]]] ^ self.bits[k][self.at[k][j[some]]]).sum(1)
        return out


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), DOCS_AT_ONCE):
            part = batch.iloc[at : at + DOCS_AT_ONCE]
            sets = shingle_sets(part["text"].tolist())
            made = [entries(x) for x in sets]
            yield pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy(), "no_id": part["no_id"].to_numpy(), "key": part["key"].to_numpy(), "n": [len(x) for x in sets],
                "sid": [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], "parity": [parity(x) for x in sets],
                "entries": [e.tobytes() for e, _ in made], "thin": [t for _, t in made],
            })


def _indexed(batches: Iterator[pd.DataFrame], left_out: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[pd.DataFrame]:
    """Index rows. Of a batch's rows with one entry the first is dealt by the entry (up -1, or -2 if there are others); the others point up to it."""
    for batch in batches:
        if left_out:
            batch = batch[~left_out(batch["h"].to_numpy())]
        e = np.frombuffer(b"".join(batch["entries"]), np.int64)
        cid = np.repeat(batch["cid"].to_numpy(), [len(b) // 8 for b in batch["entries"]])
        order = np.lexsort((cid, e))
        e, cid = e[order], cid[order]
        if not len(e):
            continue
        new = np.r_[True, e[1:] != e[:-1]]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(e)])
        up = np.repeat(cid[starts], sizes)
        yield pd.DataFrame({"entry": e, "cid": cid, "up": np.where(new, np.where(np.repeat(sizes > 1, sizes), -2, -1), up)})


def shared_entries(rows: DataFrame, left_out: Callable[[np.ndarray], np.ndarray], others: DataFrame) -> DataFrame:
    """entry, cid, up: the entries that more than one row has; those of one row alone are dropped.

    rows (cid, entries, h) without those for whose h left_out is true, and others (cid, entries).
    """
    schema = "entry long, cid long, up long"
    index = rows.select("cid", "entries", "h").mapInPandas(lambda b: _indexed(b, left_out), schema).unionByName(others.select("cid", "entries").mapInPandas(_indexed, schema)).withColumn("salt", F.when(F.col("up") >= 0, F.col("cid")).otherwise(-1))
    w = Window.partitionBy("entry", "salt").orderBy("cid")
    met = index.select("entry", "cid", "up", F.lag("cid").over(w).alias("before"), F.lead("cid").over(w).alias("after"))
    return met.filter("up <> -1 or before is not null or after is not null").select("entry", "cid", "up")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All that was parsed; rows (doc_id, key, n, cid) and classes of equal sets (cid, key, n, parity, thin, least_doc), and what classes share of the index (entry, cid, up), all saved."""
    keyed = docs.select(*whole_id(docs), F.coalesce(F.col("text"), F.lit("")).alias("text"), _key(F.col("doc_id"), F.col("text")).alias("key"))
    rows = saved(own_id(keyed.mapInPandas(_parsed, "doc_id long, no_id boolean, key long, n long, sid binary, parity binary, entries binary, thin boolean")).withColumn("uid", F.monotonically_increasing_id()), "jaccard-rows")
    hashed = rows.withColumn("h", F.xxhash64("sid"))
    test = repeat_test(hashed.select("h"), rows.count())
    flagged = hashed.withColumn("maybe", (F.col("n") > 0) & as_column(test))
    slim = saved(flagged.select("doc_id", "key", "n", "uid", "maybe", F.when(F.col("maybe"), F.col("sid")).alias("sid")), "jaccard-slim")
    groups = slim.filter("maybe").groupBy("sid").agg(F.min("uid").alias("cid"), F.min("doc_id").alias("least_doc"))
    groups = saved(groups, "jaccard-groups")
    member = slim.filter("maybe").join(groups, "sid").select("doc_id", "key", "n", "cid").unionByName(slim.filter("not maybe").select("doc_id", "key", "n", F.col("uid").alias("cid")))
    twice = slim.filter("maybe").select("uid").join(groups.select(F.col("cid").alias("uid"), "least_doc"), "uid")
    kept = ["uid", "key", "n", "parity", "thin"]
    repeated = flagged.filter("maybe").select("uid", "entries").join(saved(twice.select("uid"), "jaccard-firsts"), "uid", "left_semi").withColumnRenamed("uid", "cid")
    shared_rows = shared_entries(hashed.withColumnRenamed("uid", "cid"), test, saved(repeated, "jaccard-repeated"))
    single = flagged.filter("not maybe").select(*kept, F.col("doc_id").alias("least_doc"))
    shared = flagged.filter("maybe").select(*kept).join(twice, "uid").select(*kept, "least_doc")
    return rows, saved(member, "jaccard-members"), saved(single.unionByName(shared).withColumnRenamed("uid", "cid"), "jaccard-classes"), saved(shared_rows, "jaccard-shared")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) of classes those at 0.8 or more. Only the sets of classes in pairs move: once by their key, and once more with a pair."""
    need = saved(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "key"), "cid"), "jaccard-need")
    side = lambda c: need.select(F.col("cid").alias(c), F.col("key").alias(f"key_{c}"))
    keyed = saved(pairs.join(side("a"), "a").join(side("b"), "b"), "jaccard-keyed")
    test = repeat_test(need.select(F.col("key").alias("h")), need.count(), 1)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[test(batch["h"].to_numpy())].drop_duplicates("h")
            for at in range(0, len(batch), DOCS_AT_ONCE):
                part = batch.iloc[at : at + DOCS_AT_ONCE]
                yield pd.DataFrame({"h": part["h"].to_numpy(), "set": [x.tobytes() for x in shingle_sets(part["text"].tolist())]})

    found = docs.select(_key(F.col("doc_id"), F.col("text")).alias("h"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInPandas(sets, "h long, set binary")
    parsed = saved(found, "jaccard-sets")
    held = parsed.dropDuplicates(["h"])

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= 80 * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    left = keyed.join(held.select(F.col("h").alias("key_a"), F.col("set").alias("set_a")), "key_a")
    both = left.join(held.select(F.col("h").alias("key_b"), F.col("set").alias("set_b")), "key_b")
    out = saved(both.withColumn("ok", similar("set_a", "set_b")).select("a", "b", "ok"), "jaccard-verified")
    dropped(parsed)
    return out


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that the exact bounds on sizes and parity bits leave, before any text is read for them."""

    @F.pandas_udf("boolean")
    def near(p: pd.Series, q: pd.Series, most: pd.Series) -> pd.Series:
        k = np.arange(len(p))
        return pd.Series(Parities([*p, *q]).differ(k, k + len(p)) <= most.to_numpy())

    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("5 * n_a >= 4 * n_b and 5 * n_b >= 4 * n_a")
    return both.filter(near("p_a", "p_b", F.floor((F.col("n_a") + F.col("n_b")) / 9))).select("a", "b")


def _joining(side: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Of pairs (i, j) those that connect sides not connected by the pairs before, and the sides after that."""
    up = list(range(int(side.max()) + 1))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    used = []
    for k, (x, y) in enumerate(zip(side[i].tolist(), side[j].tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            used.append(k)
    return used, np.array([top(x) for x in range(len(up))])[side]


def _close(rows: pd.DataFrame, group: np.ndarray, forest: bool) -> pd.DataFrame:
    """Pairs within groups that lie in different components and pass the bounds on sizes and parity bits, found offset by offset.

    With forest only as many as would connect the components.
    """
    cid, n = rows["cid"].to_numpy(), rows["n"].to_numpy()
    side = np.unique(rows["root"].to_numpy(), return_inverse=True)[1]
    bits = Parities(rows["parity"].tolist())
    found, step, left = [], 1, np.arange(len(rows) - 1)
    while len(left):
        left = left[left + step < len(rows)]
        left = left[group[left + step] == group[left]]
        i, j = left, left + step
        ok = (side[i] != side[j]) & (5 * n[j] >= 4 * n[i]) & (5 * n[i] >= 4 * n[j])
        i, j = i[ok], j[ok]
        near = bits.differ(i, j) <= (n[j] + n[i]) // 9
        i, j = i[near], j[near]
        if forest and len(i):
            used, side = _joining(side, i, j)
            i, j = i[used], j[used]
        found.append(np.stack([np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])], 1))
        step += 1
    x = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": x[:, 0], "b": x[:, 1]})


def _unsettled(shared: DataFrame, roots: DataFrame, classes: DataFrame, forest: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes that share a bucket but, so far, no component (see _close()), and the rows of such buckets, which hold all that a later round needs."""
    info = saved(shared.select("cid").distinct().join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", F.coalesce("root", "cid").alias("root")), "jaccard-rooted")
    placed = shared.select("entry", "cid").join(info, "cid")
    spread = placed.groupBy("entry").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("entry")
    rows = saved(placed.join(spread, "entry", "left_semi"), "jaccard-unsettled")
    facts = rows.select("cid").distinct().join(classes.select("cid", "n", "parity"), "cid")
    full = blocks(rows, "entry", "cid", BLOCK).join(facts, "cid")
    return group_pairs(full, ["entry", "lo", "hi"], ["cid"], lambda x, g: _close(x, g, forest), "a long, b long").distinct(), rows


def _thin_pairs(docs: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Pairs of thin classes and all others with a common shingle and fitting sizes; None in the usual case that no class is thin."""
    thin = classes.filter("thin").select("cid", "key", "n")
    if not thin.head(1):
        return None

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), DOCS_AT_ONCE):
                part = batch.iloc[at : at + DOCS_AT_ONCE]
                sets = shingle_sets(part["text"].tolist())
                yield pd.DataFrame({"cid": np.repeat(part["cid"].to_numpy(), [len(x) for x in sets]), "n": np.repeat(part["n"].to_numpy(), [len(x) for x in sets]), "x": np.concatenate(sets).view(np.int64)})

    text = docs.select(_key(F.col("doc_id"), F.col("text")).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    of = lambda c: text.join(c.select("cid", "key", "n"), "key").select("cid", "n", "text").mapInPandas(shingles, "cid long, n long, x long").dropDuplicates(["cid", "x"])
    few, every = of(thin), of(classes)
    met = few.select(F.col("cid").alias("p"), F.col("n").alias("np"), "x").join(every, "x").filter("p <> cid and 5 * n >= 4 * np and 5 * np >= 4 * n")
    return met.select(F.least("p", "cid").alias("a"), F.greatest("p", "cid").alias("b")).distinct()


def _key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text, F.lit("")))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by links of 0.8 or more), class_id.

    Rows with equal shingle sets share class_id. Null text is empty; texts without words have n_shingles 0 and their own doc_id. Repeated rows are
    copies of each other. Empty tables give empty results; other columns are not read.
    """
    return _component_rows(docs).drop("key", "root")


def _component_rows(docs: DataFrame) -> DataFrame:
    """jaccard_components() with key, by which the rows of docs are found again, and root, which tells components apart that share their smallest doc_id."""
    rows, members, classes, shared = _classes(docs)
    dropped(rows)
    least = shared.filter("up < 0").groupBy("entry").agg(F.min("cid").alias("least"))
    star = shared.filter("up < 0").join(least, "entry").select("cid", F.col("least").alias("to")).unionByName(shared.filter("up >= 0").select("cid", F.col("up").alias("to"))).filter("cid <> to")
    best = star.groupBy("cid", "to").agg(F.count(F.lit(1)).alias("times")).groupBy("cid").agg(F.max_by("to", F.struct("times", -F.col("to"))).alias("to"))
    pairs = saved(_plausible(best.select(F.least("cid", "to").alias("a"), F.greatest("cid", "to").alias("b")).distinct(), classes), "jaccard-pairs")
    tried = _verified(docs, classes, pairs)
    links = tried.filter("ok").select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(links)
    for forest in (True, False):
        more, shared = _unsettled(shared, roots, classes, forest)
        if forest:  # what else is near in a bucket lies in components that these pairs touch
            more = saved(more, "jaccard-forest")
            touched = more.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(shared.select("cid", "root").distinct(), "cid").select("root").distinct()
            shared = shared.join(touched, "root", "left_semi").select("entry", "cid")
        thin = None if forest else _thin_pairs(docs, classes)
        more = more if thin is None else more.unionByName(thin).distinct()
        pairs = saved(more.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        if pairs.head(1):
            late = _verified(docs, classes, pairs)
            tried, links = tried.unionByName(late), links.unionByName(late.filter("ok").select(F.col("a").alias("u"), F.col("b").alias("v")))
            roots = components(links)
    rooted = classes.select("cid", "least_doc").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least_doc = rooted.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    named = rooted.select("cid", "root").join(least_doc, "root")
    out = members.join(named, "cid")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("cid").alias("class_id"), "key", "root")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: one row of its smallest doc_id; all columns kept, whatever their names.

    Texts without words all stay, and rows without doc_id. If several rows have a component's smallest doc_id, the text with the least hash stays, and of rows
    that repeat it one, by a hash of the row. Rows that stay and are told from all others by their key pass straight through a Bloom filter of the rest, so only rows that
    go, repeats and false alarms shuffle with all their columns. Empty tables stay empty.
    """
    rows = saved(_component_rows(docs), "jaccard-verdict")
    first = rows.filter("n_shingles > 0 and doc_id = component_id").groupBy("root", "key").agg(F.count(F.lit(1)).alias("times"))
    full = first.groupBy("root").agg(F.min_by(F.struct("key", "times"), "key").alias("k")).select("k.key", "k.times")
    other = rows.filter("n_shingles = 0 or doc_id is null").select("key", F.lit(1).alias("times")).distinct()
    stay = saved(full.unionByName(other).withColumnRenamed("key", "kept_key"), "jaccard-kept")
    sure = stay.filter("times = 1").select(F.col("kept_key").alias("key"))
    open_keys = saved(rows.select("key").join(sure, "key", "left_anti").select(F.col("key").alias("h")), "jaccard-open")
    flagged = named_row(docs).withColumn("h", _key(F.col("row.doc_id"), F.col("row.text"))).withColumn("maybe", as_column(repeat_test(open_keys, open_keys.count(), 1)))
    kept = flagged.filter("maybe").join(stay, F.col("h") == F.col("kept_key"))
    once = flagged.filter(~F.col("maybe")).select("row").unionByName(kept.filter("times = 1").select("row"))
    if not stay.filter("times > 1").head(1):
        return unnamed_row(once, docs.columns)
    again = kept.filter("times > 1").groupBy("h").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return unnamed_row(once.unionByName(again), docs.columns)
