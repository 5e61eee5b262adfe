"""Line deduplication by an exact set-similarity join.

A line's set is its distinct words, in order of rarity (by a table of hashed counts over all documents, of bounded size; ties by hash). Sets x, y with Jaccard
similarity of at least 0.8 have at least need = ceil(4 (|x| + |y|) / 9) words in common. These filters follow from that before any pair is made:

prefix: common words split the order into gaps, and each word of one line alone breaks at most one gap. So among the first |x| + |y| - 2 need + 1 gaps one is
    whole: two words that stand side by side in both orders. Only pairs of neighbours within the prefix that this allows are indexed (see prefix_of()).
rarity: words that occur once in the corpus are in no other line. They are left out of the order, shorten the prefix, and end it where they are too many.
length, position: lines meet only at fitting sizes, and only if the words before and behind the shared neighbours leave room for `need` in common. Exact bounds
    from parity bits of both sets come with them: where an entry's lines meet all of this is known already, so few pairs are ever made.

A line goes if an earlier line, in order of (doc_id, line number), is similar to it. So one earlier partner is enough: each distinct set first tries, of the
earlier lines of its entries, the one that it shares most entries with, and then all others if that one fails. Entries of more than FEW lines link their
lines to LEADERS of them. Lines that are still there after that meet all earlier ones of the smallest of their entries, and those still there then all earlier ones
of all these entries, so that pairs that share many are mostly made once. What passes the filters is verified on the words.
Equal sets are one class: its first line stays or goes by the join and all later ones go.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walflow.llm.common import dropped, named_row, own_id, saved, whole_id, with_text
from walflow.llm.exact_dedup import as_column, repeat_test
from walflow.llm.jaccard_join import mixed
from walflow.llm.words import in_parts, joined, word_hashes

LEAST_SET = 4  # smaller sets are at 0.8 only if equal
LEAST_BITS, MOST_BITS, CHUNK_BITS = 16, 25, 16
LINES_AT_ONCE = 60_000  # a line's number in its part has 16 bits below
PART_CHARS = 1_000_000
PLACE_BITS = 16  # of an entry, above its hash; the highest bit marks the line that stands for many others
ENTRY_BYTES = 5  # of a hash; in a line's row its place is where it stands
MOST_PLACE, MARK = (1 << PLACE_BITS - 1) - 1, np.uint64(1 << 63)
SKETCH_BITS, MOST_SIZE = 32, (1 << 8) - 1  # of a sketch: parity bits below the set's size
FEW, LEADERS = 16, 4
ENTRIES_AT_ONCE, SEGMENT_ENTRIES, ORDER_BITS = 2_000_000, 1 << 20, 24
_LAST = (1 << 63) - 1


def word_counts(docs: DataFrame, bits: int) -> np.ndarray:
    """How often a word occurs, by hash into 2**bits counts: exact up to 200, then on a scale of logarithms. At most 32 MB, whatever the corpus."""
    size, chunk = 1 << bits, 1 << min(bits, CHUNK_BITS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(size, np.uint32), 0
        for batch in batches:
            for _, some in in_parts([t or "" for t in batch["text"]], PART_CHARS):
                at = (word_hashes(joined(some)[0])[1] >> np.uint64(64 - bits)).astype(np.int64)
                n += len(at)
                if n > 2**30:
                    total, n = np.minimum(total, np.uint32(2**30)), len(at)
                np.add.at(total, at, np.uint32(1))
        total = np.minimum(total, np.uint32(2**30))
        for k in range(size // chunk):
            part = total[k * chunk : (k + 1) * chunk]
            if part.any():
                yield pd.DataFrame({"k": [k], "n": [zstandard.compress(part.tobytes(), 1)]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(chunk, np.int64)
        for b in rows["n"]:
            total += np.frombuffer(zstandard.decompress(b), np.uint32)
        scale = np.where(total <= 200, total, np.minimum(255, 200 + np.log2(np.maximum(total, 1)) * 2 - 15)).astype(np.uint8)
        return pd.DataFrame({"k": rows["k"][:1], "n": [zlib.compress(scale.tobytes(), 1)]})

    out = np.zeros(size, np.uint8)
    parts = saved(docs.select("text").mapInPandas(count, "k long, n binary").groupBy("k").applyInPandas(add, "k long, n binary"), "lines-counts")
    for r in parts.toLocalIterator():
        out[r["k"] * chunk : (r["k"] + 1) * chunk] = np.frombuffer(zlib.decompress(r["n"]), np.uint8)
    dropped(parts)
    return out


@lru_cache(maxsize=1 << 17)
def prefix_of(n: int, once: int) -> int:
    """How many words of a set's order, without the `once` words that no other line has, the prefix holds; 0 if no set can be at 0.8.

    With m and k words on the two sides alone, the first whole gap is at most the (m + k + 1)-th and has at most m of this side's own words before it.
    """
    other = np.arange(-(-4 * n // 5), 5 * n // 4 + 1)
    need = -(-4 * (n + other) // 9)
    alone = n - once - need
    fits = (alone >= 0) & (need <= other)
    return min(n - once, int((2 * alone + other - need + 2)[fits].max())) if n >= LEAST_SET and fits.any() else 0


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*whole_id(docs), text.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("key"))


def _lines(docs: DataFrame, table, bits: int) -> DataFrame:
    """A row for each line with words: doc_id, key, line, n, kept (n without the words that occur once), sid, p and q (parity bits), sketch, entries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = table.value
        for batch in batches:
            ids, none, keys = (batch[c].to_numpy() for c in ("doc_id", "no_id", "key"))
            for first, some in in_parts(batch["text"].tolist(), PART_CHARS):
                whole, begins = joined(some)
                start, x = word_hashes(whole)
                ends = np.flatnonzero(np.frombuffer(whole, np.uint8) == 10)
                line = np.searchsorted(ends, start)
                lead = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else []
                for a in range(0, len(lead), LINES_AT_ONCE):
                    low, high = lead[a], lead[a + LINES_AT_ONCE] if a + LINES_AT_ONCE < len(lead) else len(x)
                    made, its = rows(x[low:high], line[low:high], counts)
                    doc = np.searchsorted(begins, start[lead[a : a + LINES_AT_ONCE]], side="right") - 1
                    yield pd.DataFrame({"doc_id": ids[first + doc], "no_id": none[first + doc], "key": keys[first + doc], "line": its - np.searchsorted(ends, begins)[doc]} | made)

    def rows(x: np.ndarray, line: np.ndarray, counts: np.ndarray) -> tuple[dict, np.ndarray]:
        rare = counts[(x >> np.uint64(64 - bits)).astype(np.int64)]
        number = np.cumsum(np.r_[False, line[1:] != line[:-1]])
        some = x & np.uint64((1 << 40) - 1)
        order = np.argsort((number.astype(np.uint64) << np.uint64(48)) | (rare.astype(np.uint64) << np.uint64(40)) | some)
        if ((some[order][1:] == some[order][:-1]) & (x[order][1:] != x[order][:-1])).any():  # 40 bits do not tell two words apart
            order = np.lexsort((x, some, rare, number))
        y, number, rare = x[order], number[order], rare[order]
        new = np.r_[True, (y[1:] != y[:-1]) | (number[1:] != number[:-1])]
        y, number, rare = y[new], number[new], rare[new]
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        n = np.diff(np.r_[starts, len(y)])
        once = np.add.reduceat((rare == 1).astype(np.int64), starts)
        sizes, back = np.unique((n << 32) | once, return_inverse=True)
        prefix = np.array([prefix_of(x >> 32, x & 0xFFFFFFFF) for x in sizes.tolist()])[back]
        place = np.arange(len(y)) - (starts + once)[number]
        use = (place >= 0) & (place < prefix[number] - 1)
        at = np.flatnonzero(use)
        with np.errstate(over="ignore"):
            entry = mixed(y[at] * np.uint64(0x9E3779B97F4A7C15) + y[at + 1]) >> np.uint64(PLACE_BITS)
        entry = np.ascontiguousarray(entry.view(np.uint8).reshape(-1, 8)[:, :ENTRY_BYTES]).tobytes()
        odd = np.bitwise_xor.reduceat(np.uint64(1) << ((y >> np.uint64(8)) % np.uint64(SKETCH_BITS)), starts)
        bit = np.uint64(1) << (y & np.uint64(63))
        half = (y >> np.uint64(6)) & np.uint64(1) == 0
        cut, raw = (np.r_[0, np.cumsum(use)][np.r_[starts, len(y)]] * ENTRY_BYTES).tolist(), y.tobytes()
        edge = (np.r_[starts, len(y)] * 8).tolist()
        made = {
            "n": n, "kept": n - once, "sid": [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(edge, edge[1:], strict=False)],
            "p": np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), starts).view(np.int64), "q": np.bitwise_xor.reduceat(np.where(half, np.uint64(0), bit), starts).view(np.int64),
            "sketch": (odd | (np.minimum(n, MOST_SIZE).astype(np.uint64) << np.uint64(SKETCH_BITS))).view(np.int64),
            "entries": [entry[a:b] for a, b in zip(cut, cut[1:], strict=False)],
        }
        return made, line[np.flatnonzero(np.r_[True, line[1:] != line[:-1]])]

    return own_id(_keyed(docs).mapInPandas(run, "doc_id long, no_id boolean, key long, line int, n int, kept int, sid binary, p long, q long, sketch long, entries binary"))


_HASH = np.uint64((1 << 8 * ENTRY_BYTES) - 1)
_PACKED = "segment long, entries binary, cids binary, sketches binary"


def _entries(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The entries of lines, hash and place in one number, and how many each line has."""
    n = np.array([len(b) // ENTRY_BYTES for b in blobs], np.int64)
    wide = np.zeros((int(n.sum()), 8), np.uint8)
    wide[:, :ENTRY_BYTES] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, ENTRY_BYTES)
    place = np.arange(len(wide)) - np.repeat(np.cumsum(n) - n, n)
    return wide.view(np.uint64).ravel() | (np.minimum(place, MOST_PLACE).astype(np.uint64) << np.uint64(64 - PLACE_BITS)), n


def _near(e: np.ndarray, sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of lines that share an entry have sizes, places and parity bits that leave room for 0.8."""
    place = ((e & ~MARK) >> np.uint64(48)).astype(np.int64)
    n, odd = (sketch >> np.uint64(SKETCH_BITS)).astype(np.int64), sketch & np.uint64((1 << SKETCH_BITS) - 1)
    a, b, p, q = n[i], n[j], place[i], place[j]
    need = -(-4 * (a + b) // 9)
    room = np.minimum(p, q) + np.minimum(a - p, b - q) >= need
    size = (5 * a >= 4 * b) & (5 * b >= 4 * a) & (np.bitwise_count(odd[i] ^ odd[j]) <= a + b - 2 * need)
    return (a == MOST_SIZE) | (b == MOST_SIZE) | (size & (room | (p == MOST_PLACE) | (q == MOST_PLACE)))


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted keys where its group begins and how large it is."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.r_[start, len(key)])
    return np.repeat(start, n), np.repeat(n, n)


def _by_hash(e: np.ndarray) -> np.ndarray:
    """The order of entries by their hash."""
    h = e & _HASH
    if len(e) >= 1 << ORDER_BITS:
        return np.argsort(h)
    return (np.sort((h << np.uint64(ORDER_BITS)) | np.arange(len(e), dtype=np.uint64)) & np.uint64((1 << ORDER_BITS) - 1)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Numbers as their first bytes, then their second bytes, and so on, which compress well where the numbers are alike."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def _from_planes(parts: Iterable[bytes], kind: type) -> Iterator[np.ndarray]:
    width = np.dtype(kind).itemsize
    for b in parts:
        yield np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _steps(e: np.ndarray) -> np.ndarray:
    """Entries in order of their hash as places and the steps from one hash to the next, of which little but the low bytes is left."""
    h = e & _HASH
    return np.diff(h, prepend=h[:1] * 0) | (e & ~_HASH)


def _from_steps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x & _HASH, dtype=np.uint64) | (x & ~_HASH)


def _paired(e: np.ndarray, cid: np.ndarray, sketch: np.ndarray, all_of: np.ndarray, some_of: np.ndarray) -> np.ndarray:
    """Near pairs (smaller cid, larger cid), once each, of entries sorted by hash: all pairs of the groups of rows in all_of, those with the first LEADERS for some_of."""
    start, n = _groups(e & _HASH)
    rows, found = np.flatnonzero(some_of), []
    for step in range(LEADERS):
        rows = rows[start[rows] + step < rows]
        found.append((start[rows] + step, rows))
    left = np.flatnonzero(all_of)
    for step in range(1, FEW):
        left = left[left + step < (start + n)[left]]
        found.append((left, left + step))
    near = []
    for i, j in found:
        ok = _near(e, sketch, i, j) & (cid[i] != cid[j])
        near.append(np.stack([np.minimum(cid[i[ok]], cid[j[ok]]), np.maximum(cid[i[ok]], cid[j[ok]])], 1))
    return np.unique(np.concatenate(near), axis=0)


def met_lines(rows: DataFrame, left_out: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Rows (a, b): near pairs of lines that share an entry, each at least once; and rows (a, entry) for the lines of entries with more than FEW, of which
    only the pairs with the first LEADERS are made.

    rows (cid, entries, sketch, h, own) without those for whose h and own left_out is true. Entries travel packed, by ranges of their hash. Of an entry that a task
    holds more than FEW times one copy travels, so that no range grows with a frequent entry.
    """
    segments = 1 + (rows.agg(F.sum(F.octet_length("entries"))).first()[0] or 0) // (ENTRY_BYTES * SEGMENT_ENTRIES)

    def row(segment: int, *blobs: bytes) -> pd.DataFrame:
        return pd.DataFrame({"segment": [segment - 2 * zlib.crc32(b"".join(blobs)) if segment < 0 else segment], "entries": blobs[:1], "cids": blobs[1:2], "sketches": blobs[2:]})

    def deal(e: np.ndarray, cid: np.ndarray, sketch: np.ndarray) -> Iterator[pd.DataFrame]:
        order = _by_hash(e)
        e, cid, sketch = e[order], cid[order], sketch[order]
        start, n = _groups(e & _HASH)
        many = n > FEW
        if many.any():
            yield row(-1, _planes(_steps(e[many])), _planes(cid[many]), b"")
            pairs = _paired(e, cid, sketch, np.zeros(len(e), bool), many)
            yield row(-2, b"", _planes(pairs[:, 0]), _planes(pairs[:, 1]))
            e = np.where(many, e | MARK, e)
        first = ~many | (start == np.arange(len(e)))
        e, cid, sketch = e[first], cid[first], sketch[first]
        segment = ((e & _HASH) >> np.uint64(8 * ENTRY_BYTES - 32)) * np.uint64(segments) >> np.uint64(32)
        edge = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1], True]).tolist()
        for a, b in zip(edge, edge[1:], strict=False):
            yield row(int(segment[a]), _planes(_steps(e[a:b])), _planes(cid[a:b]), _planes(sketch[a:b]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            batch = batch[~left_out(batch["h"].to_numpy(), batch["own"].to_numpy())]
            e, sizes = _entries(batch["entries"].tolist())
            held.append((e, np.repeat(batch["cid"].to_numpy(), sizes), np.repeat(batch["sketch"].to_numpy(np.int64), sizes).view(np.uint64)))
            n += len(e)
            if n >= ENTRIES_AT_ONCE:
                yield from deal(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from deal(*map(np.concatenate, zip(*held, strict=True)))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        kind = rows["segment"].iloc[0]
        cid = np.concatenate(list(_from_planes(rows["cids"], np.int64)))
        if kind < 0 and kind % 2 == 0:
            return pd.DataFrame({"a": cid, "b": np.concatenate(list(_from_planes(rows["sketches"], np.int64))), "entry": pd.array([None] * len(cid), dtype="Int64")})
        e = np.concatenate(list(map(_from_steps, _from_planes(rows["entries"], np.uint64))))
        if kind >= 0:
            sketch = np.concatenate(list(_from_planes(rows["sketches"], np.uint64)))
            order = _by_hash(e)
            e, cid, sketch = e[order], cid[order], sketch[order]
            start, n = _groups(e & _HASH)
            marked = np.zeros(len(e), bool)
            marked[start[e & MARK != 0]] = True
            many = marked[start] | (n > FEW)
            pairs = _paired(e, cid, sketch, ~many, many)
            own = many & (e & MARK == 0)
            e, cid = e[own], cid[own]
        else:
            pairs = np.zeros((0, 2), np.int64)
        none = pd.array([None] * len(pairs), dtype="Int64")
        return pd.DataFrame({"a": np.r_[pairs[:, 0], cid], "b": pd.array(np.r_[pairs[:, 1], np.zeros(len(cid), np.int64)], dtype="Int64"), "entry": pd.concat([pd.Series(none), pd.Series((e & _HASH).view(np.int64), dtype="Int64")], ignore_index=True)})

    return rows.select("cid", "entries", "sketch", "h", "own").mapInPandas(run, _PACKED).groupBy("segment").applyInPandas(meet, "a long, b long, entry long")


def _facts_of(rows: DataFrame, met: DataFrame, most: int) -> DataFrame:
    """cid, doc_id, key, line, n, p and q of the lines that met others, and by false alarm of a few more: all that is read of a line from there on."""
    ids = met.select(F.explode(F.array("a", "b")).alias("id")).filter("id is not null").select(F.xxhash64("id").alias("h"))
    return rows.withColumn("h", F.xxhash64("uid")).filter(as_column(repeat_test(ids, min(most, 2 * met.count()), 1))).select(F.col("uid").alias("cid"), "doc_id", "key", "line", "n", "p", "q")


def _place() -> Column:
    """Where a line stands in the order of all lines, and the key by which its text is found."""
    return F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "line", "cid", "key").alias("at")


def _pair(a: Column, b: Column) -> list[Column]:
    """The columns of a pair of places: cids, keys and lines of both."""
    return [x[c].alias(name) for x, names in ((a, ("a", "key_a", "line_a")), (b, ("b", "key_b", "line_b"))) for c, name in zip(("cid", "key", "line"), names, strict=True)]


_FITS = "5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n and bit_count(a.p ^ b.p) + bit_count(a.q ^ b.q) <= a.n + b.n - 2 * ceil(4 * (a.n + b.n) / 9)"


def _ordered(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """pairs (a, b), a pair once for each entry, as _pair() and times with the earlier line as a, without those that all parity bits tell apart.

    Only sizes and parity bits go with all pairs; they are ordered when few are left.
    """
    side = lambda c, *values: facts.select(F.col("cid").alias(f"id_{c}"), F.struct(*values).alias(c))
    both = lambda df, *values: df.join(side("a", *values), "id_a").join(side("b", *values), "id_b")
    counted = pairs.groupBy(F.col("a").alias("id_a"), F.col("b").alias("id_b")).agg(F.count(F.lit(1)).alias("times"))
    near = saved(both(counted, "n", "p", "q").filter(_FITS).select("id_a", "id_b", "times"), "lines-near")
    return both(near, _place()).select(*_pair(F.least("a.at", "b.at"), F.greatest("a.at", "b.at")), "times")


def _held(large: DataFrame, facts: DataFrame) -> DataFrame:
    """entry, and as a all facts of a line, for the lines of large entries (cid, entry)."""
    return saved(large.join(facts, "cid").select("entry", F.struct(_place(), "n", "p", "q").alias("a")), "lines-large")


def _once(held: DataFrame) -> DataFrame:
    """Each line of held once, with the smallest of its large entries."""
    of_entry = held.groupBy("entry").agg(F.count(F.lit(1)).alias("size"))
    return held.join(of_entry, "entry").groupBy("a.at.cid").agg(F.min(F.struct("size", "entry", "a")).alias("x")).select("x.entry", "x.a")


def _earlier(others: DataFrame, held: DataFrame, gone: DataFrame) -> DataFrame:
    """_pair(): for the lines b in held that are not gone, the earlier ones of the same entry in others that size and parity bits leave."""
    there = held.join(gone.select(F.col("b").alias("cid")), F.col("a.at.cid") == F.col("cid"), "left_anti").select("entry", F.col("a").alias("b"))
    return others.join(there, "entry").filter(F.col("a.at") < F.col("b.at")).filter(_FITS).select(*_pair(F.col("a.at"), F.col("b.at"))).distinct()


def _spots(key: np.ndarray, line: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(key.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64)).view(np.int64)


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (see _pair()) as (a, b, ok): whether their sets are at 0.8 or more. Only documents that hold a line in question are read again, and only these lines' sets move."""
    sides = pairs.select(F.explode(F.array(*[F.struct(F.col(f"key_{c}").alias("key"), F.col(f"line_{c}").alias("line")) for c in "ab"])).alias("x")).select("x.*")
    most = 2 * pairs.count()
    test = as_column(repeat_test(sides.select(F.col("key").alias("h")), most, 1))
    asked = repeat_test(sides.select(F.pandas_udf(lambda key, line: pd.Series(_spots(key.to_numpy(), line.to_numpy())), "long")("key", "line").alias("h")), most, 1)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [t.split("\n") for t in batch["text"]]
            n = np.array([len(x) for x in lines], np.int64)
            key, line = np.repeat(batch["h"].to_numpy(), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = np.flatnonzero(asked(_spots(key, line)))
            flat = [x for some in lines for x in some]
            for first, part in in_parts([flat[k] for k in own], PART_CHARS):
                at = own[first : first + len(part)]
                whole, begins = joined(part)
                start, x = word_hashes(whole)
                cut = np.searchsorted(start, np.r_[begins, len(whole)]).tolist()
                yield pd.DataFrame({"h": key[at], "line": line[at], "set": [np.unique(x[a:b]).tobytes() for a, b in zip(cut, cut[1:], strict=False)]})

    held = saved(_keyed(docs).select(F.col("key").alias("h"), "text").filter(test).mapInPandas(sets, "h long, line int, set binary"), "lines-sets")
    once = held.dropDuplicates(["h", "line"])

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            out.append(100 * common >= 80 * (len(x) // 8 + len(y) // 8 - common))
        return pd.Series(out, dtype=bool)

    side = lambda c, name: once.select(F.col("h").alias(f"key_{c}"), F.col("line").alias(f"line_{c}"), F.col("set").alias(name))
    both = pairs.join(side("a", "x"), ["key_a", "line_a"]).select("a", "b", "key_b", "line_b", "x").join(side("b", "y"), ["key_b", "line_b"])
    out = saved(both.withColumn("ok", similar("x", "y")).select("a", "b", "ok"), "lines-verified")
    dropped(held)
    return out


def repeated_lines(docs: DataFrame) -> DataFrame:
    """A row for each line that goes: doc_id, key (a hash of doc_id and text), line (from 0).

    Lines end at line feeds; words end at white space and A-Z are lower-cased. Lines without words never go. Null text is empty; null doc_ids sort last;
    of rows that repeat doc_id and text, the lines count as one. Empty tables give empty results; other columns are not read.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * docs.count()).bit_length()))
    table = docs.sparkSession.sparkContext.broadcast(word_counts(docs, bits))
    rows = saved(_lines(docs, table, bits).withColumn("uid", F.monotonically_increasing_id()), "lines-rows")
    hashed = rows.withColumn("h", F.xxhash64("sid"))
    n_rows = rows.count()
    test = repeat_test(hashed.select("h"), n_rows)
    again = saved(hashed.select("uid", "doc_id", "key", "line", "sid", "h").filter(as_column(test)).drop("h"), "lines-again")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "line", "uid")
    groups = saved(again.groupBy("sid").agg(F.min(order).getField("uid").alias("cid"), F.count(F.lit(1)).alias("times")), "lines-groups")
    later = saved(again.join(groups, "sid").filter("uid <> cid").select("doc_id", "key", "line"), "lines-later")
    dropped(again)
    first = repeat_test(groups.select(F.xxhash64("cid").alias("h")), groups.count(), 1)  # a later line that it lets pass is a class of its own, which goes anyway
    dropped(groups)
    indexed = hashed.filter(F.length("entries") > 0).select(F.col("uid").alias("cid"), "h", F.xxhash64("uid").alias("own"), "entries", "sketch")
    met = saved(met_lines(indexed, lambda h, own: test(h) & ~first(own)), "lines-met")
    facts = saved(_facts_of(rows, met, n_rows), "lines-facts")
    dropped(rows)
    pairs = saved(_ordered(met.filter("entry is null").select("a", "b"), facts), "lines-pairs")
    columns = [c for c in pairs.columns if c != "times"]
    tried = _verified(docs, saved(pairs.groupBy("b").agg(F.max_by(F.struct(*columns), F.struct("times", -F.col("a"))).alias("x")).select("x.*"), "lines-first-pairs"))
    gone = tried.filter("ok").select("b")

    def next_round(pairs: DataFrame) -> None:
        nonlocal tried, gone
        rest = saved(pairs.join(gone, "b", "left_anti").join(tried.select("a", "b"), ["a", "b"], "left_anti").select(*columns), "lines-rest")
        if rest.head(1):
            late = _verified(docs, rest)
            tried, gone = tried.unionByName(late), saved(gone.unionByName(late.filter("ok").select("b")).distinct(), "lines-gone")

    large = met.filter("entry is not null").select(F.col("a").alias("cid"), "entry")  # their lines meet all earlier ones, if they are still there
    if large.head(1):
        held = _held(large, facts)
        next_round(pairs.select(*columns).unionByName(_earlier(held, _once(held), gone)).distinct())
        next_round(_earlier(held, held, gone))
    else:
        next_round(pairs)
    near = facts.join(gone.withColumnRenamed("b", "cid"), "cid", "left_semi").select("doc_id", "key", "line")
    return later.unionByName(near).distinct()


def line_report(docs: DataFrame) -> DataFrame:
    """One row per doc_id and text of docs that loses lines: doc_id, n_removed, removed_lines (comma-joined, from 0)."""
    gone = repeated_lines(docs).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return gone.select("doc_id", F.size("lines").cast("long").alias("n_removed"), F.array_join(F.col("lines").cast("array<string>"), ",").alias("removed_lines"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with later similar lines taken out of text; n_chars follows. Null text stays null; ties, repeats and empty tables are as in repeated_lines().

    Any column names will do, as a row is one column until the end.
    """
    gone = repeated_lines(docs).groupBy(F.col("key").alias("gone_key")).agg(F.collect_list("line").alias("gone"))  # at most a document's lines
    met = named_row(docs).withColumn("key", F.xxhash64(F.col("row.doc_id").cast("long"), F.coalesce(F.col("row.text"), F.lit("")))).join(gone, F.col("key") == F.col("gone_key"), "left")
    left = F.filter(F.split(F.col("row.text"), "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("gone", i.cast("int")), F.lit(False)))
    return with_text(met.withColumn("new", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))), docs.columns)
