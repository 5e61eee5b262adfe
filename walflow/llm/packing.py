"""Best-fit decreasing packing of token pieces into sequences.

Piece lengths are whole numbers up to the capacity, so the multiset of all pieces is a histogram of at most `capacity` counts, whatever the table's size.
Best-fit decreasing is run on that histogram with a segment tree over remaining capacities: the tightest open bin for a length is found in logarithmic
time, and pieces of one length are placed in runs (a bin takes as many as fit, since it stays the tightest). The runs, a few thousand rows, say where the
r-th piece of a length goes; ranks are counted in blocks, so neither the pieces nor a hot length ever meet in one task.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walflow.llm.common import numbered, own_id, saved, whole_id

CAPACITY = 2048
END_ID = 0
CACHE_WORDS, KEPT_WORDS = 300_000, 60_000
DOCS_AT_ONCE = 500
#: Separators that Python splits at and the tokenizer does not; what is not plain Latin, where only the tokenizer's own lower-casing is used.
_ODD, _FOREIGN = "\x1c\x1d\x1e\x1f", re.compile("[^\x00-\u024f]|\u0130")
#: Lower-case letters, then signs other than the apostrophe, which begins parts of its own: each of the two is one part to the tokenizer.
_PLAIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\\[-`{-~]*)")


class OpenBins:
    """A segment tree over remaining capacities 0..capacity; leaf r counts the open bins with r left."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        i = remaining + self.size
        while i:
            self.tree[i] += bins
            i //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least length that a bin has."""
        i = length + self.size
        if self.tree[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first bin, pieces a bin, offset) of best-fit decreasing for counts[length] pieces of each length."""
    tree, bins, new, runs = OpenBins(capacity), defaultdict(list), 0, []  # bins[r]: runs [first bin, number] with r left
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def place(first: int, n: int, r: int, length: int = length) -> int:
            """Puts up to n * (r // length) pieces into n bins with r left; the bins used get what remains. Returns the bins that stay as they were."""
            nonlocal rank, left
            each = min(r // length, left)
            whole = min(n, left // each)
            runs.append((length, rank, first, each, capacity - r))
            rank, left = rank + whole * each, left - whole * each
            if after := r - each * length:
                bins[after].append([first, whole])
                tree.add(after, whole)
            if whole < n and left and left < each:
                runs.append((length, rank, first + whole, left, capacity - r))
                if after := r - left * length:
                    bins[after].append([first + whole, 1])
                    tree.add(after, 1)
                rank, left, whole = rank + left, 0, whole + 1
            return n - whole

        while left:
            r = tree.tightest(length)
            if r is None:
                each = capacity // length
                n = -(-left // each)
                place(new, n, capacity)
                new += n
                continue
            first, n = bins[r].pop()
            tree.add(r, -n)
            if rest := place(first, n, r):
                bins[r].append([first + n - rest, rest])
                tree.add(r, rest)
    return runs


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> tuple[Callable[[str], bytes], Callable[[], None]]:
    """text -> its ids as little-endian unsigned 32-bit numbers, equal to the tokenizer file's own encoding of the whole text; and what forgets all but KEPT_WORDS words.

    Each white-space-free stretch is encoded once and remembered, as this tokenizer never looks across white space. Of a lower-case
    Latin word with signs behind it the tokenizer makes two parts; these go to its merges directly and are remembered on their own too.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(path)
    merges, as_bytes = tok.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    known: dict[str, bytes] = {}
    parts: dict[str, bytes] = {"": b""}

    def numbers(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def part(p: str) -> bytes:
        ids = parts.get(p)
        if ids is None:
            ids = parts[p] = numbers([t.id for t in merges.tokenize(p if p.isascii() else as_bytes.pre_tokenize_str(p)[0][0])])
        return ids

    def learn(words: set[str]) -> None:
        others = []
        if len(parts) > CACHE_WORDS // 2:
            parts.clear()
            parts[""] = b""
        for w in words:
            if plain := _PLAIN.fullmatch(w):
                known[w] = part(plain[1]) + part(plain[2])
            else:
                others.append(w)
        for at in range(0, len(others), 20_000):
            some = others[at : at + 20_000]
            known.update(zip(some, (numbers(e.ids) for e in tok.encode_batch_fast(some, add_special_tokens=False)), strict=True))

    def encode(text: str) -> bytes:
        if any(c in text for c in _ODD):
            return numbers(tok.encode(text, add_special_tokens=False).ids)
        plain = "<|" not in text and (text.isascii() or not _FOREIGN.search(text))
        words = (text.lower() if plain else text).split()
        ids = list(map(known.get, words))
        if None in ids:
            if len(known) > CACHE_WORDS:
                known.clear()
            learn(set(words).difference(known))
            ids = map(known.__getitem__, words)
        return b"".join(ids)

    def forget() -> None:
        for held in (known, parts):  # the words met first are mostly frequent ones
            first = list(islice(held.items(), KEPT_WORDS))
            held.clear()
            held.update(first)

    return encode, forget


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. A document is its ids and then END_ID; only longer ones are cut."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        (encode, forget), end = word_tokenizer(tokenizer_path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), DOCS_AT_ONCE):
                rows = []
                for doc, none, text in zip(*(batch[c].tolist()[at : at + DOCS_AT_ONCE] for c in ("doc_id", "no_id", "text")), strict=True):
                    ids = encode(text or "") + end
                    for k in range(0, len(ids), 4 * capacity):
                        part = ids[k : k + 4 * capacity]
                        rows.append((doc, none, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
                yield pd.DataFrame(rows, columns=["doc_id", "no_id", "piece", "start", "length", "ids_crc32"])
        forget()  # the worker process may have other stages' tasks next

    return own_id(docs.select(*whole_id(docs), "text").mapInPandas(cut, "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long"))


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0 in each sequence).

    Null text is empty and packs as END_ID alone. Repeated rows are packed once each. Ties of length are placed in order of a hash of the piece.
    Empty tables give empty results; other columns are not read.
    """
    pieces = saved(token_pieces(docs, tokenizer_path, capacity).withColumn("uid", F.monotonically_increasing_id()), "packing-pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = np.array(sorted(pack_histogram(counts, capacity), key=lambda r: (r[0], r[1])) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    spread = F.shiftrightunsigned(F.xxhash64("uid", "ids_crc32"), 36)
    ranked = numbered(pieces, "length", spread, [F.col("uid")], "rank", per_block=20_000)
    plan = docs.sparkSession.sparkContext.broadcast(runs)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        runs = plan.value
        at = np.searchsorted(runs[:, 0] * (1 << 44) + runs[:, 1], length.to_numpy() * (1 << 44) + rank.to_numpy(), side="right") - 1
        k = rank.to_numpy() - runs[at, 1]
        return pd.DataFrame({"sequence_id": runs[at, 2] + k // runs[at, 3], "offset": runs[at, 4] + k % runs[at, 3] * length.to_numpy()})

    return ranked.withColumn("at", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
