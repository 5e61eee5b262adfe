"""Personal data: base patterns, and a character tagger that adds what they miss.

Windows of 128 characters overlap by half. A span counts only if it holds a digit or an @, so only windows with one are scored. Windows that follow each
other make a stretch: where two overlap their scores are averaged, nearer to a window's middle with more weight, and the CRF's best path is found over the
whole stretch, as if the text behind it were outside. A span that reaches a stretch's edge adds the next window, and the stretch is decoded again. Stretches
longer than MOST_WINDOWS windows (a quarter of a million characters) are cut there, so memory is bounded; a span may cross the cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walflow.llm.common import named_row, own_id, whole_id, with_text
from walflow.llm.tagger import CODES, KINDS, PAD, TAGS, WINDOW, best_tags, emissions, encoded, trained
from walflow.llm.words import in_parts

HALF = WINDOW // 2
SIDE = WINDOW // 4
AT_ONCE, MOST_WINDOWS = 512, 4096
_TENT = np.minimum(np.arange(WINDOW) + 0.5, WINDOW - np.arange(WINDOW) - 0.5).astype(np.float32)
_OUTSIDE = np.r_[0, np.full(TAGS - 1, -1e4)].astype(np.float32)
_TRIGGERS = np.isin(np.arange(256), CODES[[ord(c) for c in "0123456789@"]])
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_TRIGGER = re.compile("[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, int]]:
    """Leftmost matches in linear time: from each @ back over the local part, but not into the last match, and on over the domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield 0, start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    if not _TRIGGER.search(text):
        return []
    out = list(_emails(text))
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0]))


def _plausible(kind: int, s: str) -> bool:
    """The least that a tagged span must hold."""
    d = len(re.findall("[0-9]", s))
    return (kind == 0 and "@" in s[1:-1]) or (kind == 1 and s.count(".") == 3 and d >= 4) or (kind == 2 and 12 <= d <= 19) or (kind == 3 and 7 <= d <= 15) or (kind == 4 and len(s) >= 16 and d >= 4)


def _stretch_tags(codes: np.ndarray, first: np.ndarray, last: np.ndarray, weights: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The tags of stretches, each the windows first..last of the codes: scores are averaged where windows overlap, and each stretch is decoded as a whole."""
    blocks = last - first + 2
    scores = np.zeros((len(first), int(blocks.max()), HALF, TAGS), np.float32)
    total = np.zeros(scores.shape[:2] + (HALF, 1), np.float32)
    row = np.repeat(np.arange(len(first)), blocks - 1)
    block = np.arange(len(row)) - np.repeat(np.cumsum(blocks - 1) - blocks + 1, blocks - 1)
    for a in range(0, len(row), AT_ONCE):
        i, k = row[a : a + AT_ONCE], block[a : a + AT_ONCE]
        s = emissions(weights, codes[(first[i] + k)[:, None] * HALF + np.arange(WINDOW)])
        for side in (0, 1):  # a window's halves are added to the blocks on which they stand, by their distance from the window's edge
            part = slice(side * HALF, (side + 1) * HALF)
            scores[i, k + side] += s[:, part] * _TENT[part, None]
            total[i, k + side] += _TENT[part, None]
    scores /= np.maximum(total, 1e-9)
    scores[np.arange(scores.shape[1]) >= blocks[:, None]] = _OUTSIDE
    tags = best_tags(weights, scores.reshape(len(first), -1, TAGS))
    return [t[: n * HALF] for t, n in zip(tags, blocks, strict=True)]


def tagged_spans(texts: list[str], weights: dict[str, np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The tagger's plausible spans of each text."""
    blocks = np.array([-(-len(t) // HALF) for t in texts], np.int64)
    base = np.r_[0, np.cumsum(blocks + 1)] * HALF  # a text lies SIDE behind its base; window g begins at g * HALF
    codes = np.full(base[-1], CODES[PAD], np.uint8)
    valid = np.ones(len(codes) // HALF, bool)
    valid[base[1:] // HALF - 1] = False  # windows that would reach into the next text
    for text, b in zip(texts, base, strict=False):
        codes[b + SIDE : b + SIDE + len(text)] = encoded(text)
    at = np.flatnonzero(_TRIGGERS[codes]) // HALF
    live = np.zeros(len(valid), bool)
    live[at] = live[np.maximum(at - 1, 0)] = True
    live &= valid
    tags, done = np.zeros(len(codes), np.int8), set()
    while True:
        edge = np.diff(np.r_[False, live, False].astype(np.int8))
        runs = [(a, min(a + MOST_WINDOWS, b) - 1) for x, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True) for a in range(x, b, MOST_WINDOWS)]
        new = sorted((r for r in runs if r not in done), key=lambda r: (r[1] - r[0], r))
        if not new:
            break
        done.update(new)
        while new:  # stretches of like length together
            n = len(new)
            while n > 1 and n * (new[n - 1][1] - new[n - 1][0] + 2) > MOST_WINDOWS:
                n = n // 2
            some, new = np.array(new[:n]), new[n:]
            for (a, b), t in zip(some.tolist(), _stretch_tags(codes, some[:, 0], some[:, 1], weights), strict=True):
                tags[a * HALF : (b + 2) * HALF] = t
                live[max(a - 1, 0)] |= bool(t[0])
                live[min(b + 1, len(live) - 1)] |= bool(t[-1])
        live &= valid
    kind = np.where(tags > 0, (tags.astype(np.int64) - 1) // 2, -1)
    begins = np.flatnonzero((tags > 0) & ((tags % 2 == 1) | (np.r_[-1, kind[:-1]] != kind)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, d in zip(begins.tolist(), (np.searchsorted(base, begins, side="right") - 1).tolist(), strict=True):
        b = a + 1
        while b < len(tags) and tags[b] == 2 + 2 * kind[a]:
            b += 1
        low, high = max(0, a - base[d] - SIDE), min(len(texts[d]), b - base[d] - SIDE)
        if kind[a] == 4 and low < high:  # a key has no white space
            high = low + len((texts[d][low:high].split(maxsplit=1) or [""])[0])
        s = texts[d][low:high]
        if _TRIGGER.search(s) and _plausible(int(kind[a]), s):
            out[d].append((int(kind[a]), int(low), int(high)))
    return out


def all_spans(texts: list[str], weights: dict[str, np.ndarray]) -> list[tuple[list, list]]:
    """For each text its base spans, and these with the tagged spans that overlap none of them."""
    out = []
    for _, some in in_parts(texts):
        live = [i for i, t in enumerate(some) if _TRIGGER.search(t)]
        tagged = dict(zip(live, tagged_spans([some[i] for i in live], weights) if live else [], strict=True))
        for i, t in enumerate(some):
            base = base_spans(t)
            free = [m for m in tagged.get(i, []) if not any(m[1] < b[2] and b[1] < m[2] for b in base)]
            out.append((base, sorted(base + free, key=lambda s: (s[1], s[0]))))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def without_spans(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; spans that overlap one before them go with it."""
    parts, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            parts += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null text is empty. Offsets are code points, ends exclusive. Repeated rows get a row each. Empty tables give empty results; other columns are not read.
    """
    weights = docs.sparkSession.sparkContext.broadcast(trained())

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = all_spans([t or "" for t in batch["text"]], weights.value)
            counts = {f"n_{k}": [sum(s[0] == i for s in b) for b, _ in found] for i, k in enumerate(KINDS[:4])}
            yield pd.DataFrame({"doc_id": batch["doc_id"], "no_id": batch["no_id"], **counts, "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], "spans": [joined(a) for _, a in found]})

    return own_id(docs.select(*whole_id(docs), "text").mapInPandas(scan, "doc_id long, no_id boolean, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"))


def without_pii(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets, overlaps as one, until none is left; n_chars, if there is such a column, follows.

    Each round takes at least a digit or an @ out of a text, so it ends. Null text stays null. Repeated rows stay repeated, and empty tables stay empty; a text's result depends on that text alone. Other columns are unchanged,
    whatever their names.
    """
    weights = docs.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = [None if t is None or t is pd.NA else t for t in texts.tolist()]
        left = [i for i, t in enumerate(out) if t]
        while left:  # what is taken out may have hidden a span behind it
            found = all_spans([out[i] for i in left], weights.value)
            left = [i for i, (_, spans) in zip(left, found, strict=True) if spans]
            for i, spans in zip(left, (spans for _, spans in found if spans), strict=True):
                out[i] = without_spans(out[i], spans)
        return pd.Series(out, dtype=object)

    return with_text(named_row(docs).withColumn("new", clean(F.col("row.text"))), docs.columns)
