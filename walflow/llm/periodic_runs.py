"""Maximal runs of periodic words, found by the algorithm of Kolpakov and Kucherov.

A text's words are numbered. The sequence is factored from left to right, each factor being the longest stretch that also begins earlier, or one new word; a
suffix automaton with the first end of each state tells how far that goes. A run that touches a factor's edge, from either side, is found there by Main's
extensions: of the last edge b that it crosses or ends at, with factors of lengths x before and y behind it, its period is below x + y and it begins behind
b - x - period, since a factor could otherwise be longer. With an exponent of EXPONENT = 4 at least, two periods lie on one side of b, so that squares that
begin or end at b (by the Z function of the factor, or of twice the factor before, read backwards) give all candidates; a multiple of a candidate whose stretch
covers it is the same run, and only some log(y) others are left, which are extended word by word. Runs strictly inside a factor are copies of runs at
the factor's earlier place, whose own runs have all been found by then.

Words that occur fewer than EXPONENT times in a stretch belong to no run in it, as each word of a period occurs that often; so stretches are parted at them first,
again and again, in numpy. What is left is mostly repetition, and the work on it grows with its length. A stretch takes some 500 bytes a word while it is searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPONENT, LEAST = 4, 6


def factors(x: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier start, or -1 for a new symbol) of the factorisation of x. Earlier places may overlap the factor."""
    link, length, first, step = [-1], [0], [-1], [{}]
    last = 0
    for i, c in enumerate(x):
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        first.append(i)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                step.append(step[q].copy())
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    out, i, n = [], 0, len(x)
    while i < n:
        state, size, at = 0, 0, -1
        while i + size < n:
            after = step[state].get(x[i + size])
            if after is None or first[after] - size >= i:
                break
            state, size, at = after, size + 1, first[after] - size
        out.append((i, max(size, 1), at))
        i += max(size, 1)
    return out


def z_values(x: list[int]) -> list[int]:
    """For each place the length of the longest stretch from there that x begins with."""
    n, out, a, b = len(x), [0] * len(x), 0, 0
    for i in range(1, n):
        k = min(out[i - a], b - i) if i < b else 0
        if i + k >= b:
            while i + k < n and x[k] == x[i + k]:
                k += 1
            a, b = i, i + k
        out[i] = k
    return out


def _squares(z: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(p, z[p]) of the periods p up to most with a square at the beginning, without multiples of one whose stretch covers their square."""
    kept: list[tuple[int, int]] = []
    for p in range(1, most + 1):
        if z[p] >= p and not any(p % q == 0 and q + z[q] >= 2 * p for q, _ in kept):
            kept.append((p, z[p]))
            yield p, z[p]


def runs_of(x: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of the maximal runs of x with at least LEAST symbols and EXPONENT periods, by start and then period."""
    n = len(x)
    x = [*x, -1]  # what is unlike all else makes the end a factor's edge
    parts = factors(x)
    found: dict[int, dict[int, int]] = {}  # start -> end -> period

    def add(s: int, e: int, p: int, low: int, high: int) -> None:
        if e - s < max(LEAST, EXPONENT * p) or (s == low and s > 0 and x[s - 1] == x[s - 1 + p]) or (e == high and e < n and x[e] == x[e - p]):
            return  # too short, or longer than the window: then it is another edge's
        ends = found.setdefault(s, {})
        ends[e] = min(p, ends.get(e, p))

    for (a, size, _), (b, after, _) in zip(parts, parts[1:], strict=False):
        high = b + after
        if after >= 2:
            for p, ext in _squares(z_values(x[b:high]), after // 2):
                s, low = b, max(0, b - size - p)
                while s > low and x[s - 1] == x[s - 1 + p]:
                    s -= 1
                add(s, b + p + ext, p, low, high)
        if size >= 2:
            low = max(0, b - 2 * size)
            for p, ext in _squares(z_values(x[low:b][::-1]), min(size, (b - low) // 2)):
                e = b
                while e < high and x[e] == x[e - p]:
                    e += 1
                add(b - p - ext, e, p, low, high)
    if found:
        for a, size, at in parts:
            if at >= 0 and size > LEAST:
                for s in range(a + 1, a + size):
                    for e, p in found.get(s - a + at, {}).items():
                        if e + a - at < a + size:
                            found.setdefault(s, {}).setdefault(e + a - at, p)
    return sorted(((s, e, p) for s, ends in found.items() for e, p in ends.items()), key=lambda r: (r[0], r[2]))


def stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of x that may hold runs: each of their symbols occurs at least EXPONENT times in its stretch."""
    at = np.flatnonzero(np.bincount(x)[x] >= EXPONENT) if len(x) else np.zeros(0, np.int64)
    while True:
        edge = np.flatnonzero(np.diff(at) > 1) + 1
        starts, ends = np.r_[0, edge][: len(at)], np.r_[edge, len(at)][: len(at)]
        long = ends - starts >= LEAST
        if not long.any():
            return []
        number = np.repeat(np.arange(len(starts)), ends - starts)
        use = long[number]
        left, number = at[use], number[use]
        _, back, count = np.unique(number * (int(x.max()) + 1) + x[left], return_inverse=True, return_counts=True)
        often = count[back] >= EXPONENT
        if often.all() and use.all():
            return list(zip(at[starts].tolist(), (at[ends - 1] + 1).tolist(), strict=True))
        at = left[often]


def word_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of the runs of a text's words, by start and then period."""
    names: dict[bytes, int] = {}
    x = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    return [(s + a, e + a, p) for a, b in stretches(x) for s, e, p in runs_of(x[a:b].tolist())]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains behind its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for s, e, p in runs:
        change[s + p] += 1
        change[e] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """docs with columns runs (start, length, period; word numbers from 0, by start and then period) and collapsed (the text without repeated periods).

    Words are stretches without ASCII white space. Null text is empty: no runs, and collapsed is empty. A text's result depends on that text alone; repeated rows and
    the other columns stay as they are, and columns with the names of the new ones are replaced. Empty tables give empty results. A text is held whole by
    one worker, very long ones too.
    """

    @F.pandas_udf("runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    def find(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            words = (t or "").encode("utf-8", "replace").split()
            runs = word_runs(words)
            out.append(([{"start": s, "length": e - s, "period": p} for s, e, p in runs], collapsed(words, runs).decode()))
        return pd.DataFrame(out, columns=["runs", "collapsed"])

    return docs.withColumn("runs", find(F.col("text"))).withColumns({"runs": F.col("runs.runs"), "collapsed": F.col("runs.collapsed")})
