"""Hashes of the words of UTF-8 text, whole buffers at a time.

A word's hash is the sum of its bytes (A-Z lower-cased, one added) by powers of an odd multiplier modulo 2**64, mixed. Prefix sums give all words of a window
at once, so no word becomes a Python object and nothing is remembered between tasks. Words that differ collide by chance only, at 1 in 2**64 a pair, unless
they are some thousand bytes long and made to collide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15
WINDOW = 1 << 18
PART_CHARS = 2_000_000
LOWER = np.array([b + 33 if 65 <= b <= 90 else b + 1 for b in range(256)], np.uint64)  # one more than the lower-case byte, so that none is zero
SPACE = re.compile(rb"[\x09-\x0D\x20]")
_BLANK = np.array([bool(SPACE.match(bytes([b]))) for b in range(256)])
_powers = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers_to(n: int) -> list[np.ndarray]:
    """The powers of the multiplier and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(2 * n, p, np.uint64)]) for p in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64))]
    return _powers


def stretch_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of the stretches start..end of a window of bytes."""
    power, inverse = powers_to(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(LOWER[raw] * power[: len(raw)])]
        h = (sums[end] - sums[start]) * inverse[start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(MULTIPLIER)
    return h ^ (h >> np.uint64(29))


def edges(blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end, given which bytes stand between words."""
    edge = np.diff(np.r_[True, blank, True].astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def windows(whole: bytes, space: re.Pattern[bytes] = SPACE) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of stretches of about WINDOW bytes that no word crosses."""
    at = 0
    while at < len(whole):
        stop = space.search(whole, at + WINDOW)
        upto = stop.end() if stop else len(whole)
        yield at, whole[at:upto]
        at = upto


def word_hashes(whole: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word; words stand between space, tab, line feed, vertical tab, form feed and carriage return."""
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at, window in windows(whole):
        raw = np.frombuffer(window, np.uint8)
        start, end = edges(_BLANK[raw])
        if len(start):
            hashes.append(stretch_hashes(raw, start, end))
            starts.append(start + at)
    return np.concatenate(starts), np.concatenate(hashes)


def in_parts(texts: list[str], most: int = PART_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first, texts) in parts of bounded length; a longer text is a part of its own."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if i > first and held + len(t) > most:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(t)
    if texts:
        yield first, texts[first:]


def joined(texts: list[str]) -> tuple[bytes, np.ndarray]:
    """The texts in UTF-8, one after the other with a line feed behind each, and where each begins."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    return b"\n".join([*coded, b""]), np.cumsum([0, *(len(c) + 1 for c in coded)])[:-1]
