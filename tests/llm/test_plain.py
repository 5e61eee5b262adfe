"""Shards, license scans and packing against plain versions: a k-d tree in numpy, chains by comparing all matches, and best-fit decreasing one piece at a time."""

import random
import re
from collections import Counter

import numpy as np

from walflow.llm.kd_shards import DIMENSIONS, TIE_BITS, kd_shards, metadata
from walflow.llm.licenses import ENOUGH, MUST, NEIGHBOURS, PHRASES, TEMPLATES, license_scan
from walflow.llm.packing import pack_histogram


def plain_shards(rows, shards):
    """The shard of each row (size, tie, coordinates), by sorting the rows of each node."""
    out, todo = np.zeros(len(rows), int), [(np.arange(len(rows)), 0, shards)]
    size, tie = rows[:, 0], rows[:, 1]
    while todo:
        at, first, n = todo.pop()
        if n == 1 or not len(at):
            out[at] = first
            continue
        c = rows[at, 2:]
        key = (c[:, int(np.argmax(c.max(0) - c.min(0)))] << TIE_BITS) + tie[at]
        names, back = np.unique(key, return_inverse=True)
        weight = np.bincount(back, weights=size[at]).astype(int)
        run, total = np.cumsum(weight), int(size[at].sum())
        k = int(np.searchsorted(run, max(1, total * (n // 2) // n)))
        want = total * (n // 2) / n
        limit = names[k] + (abs(run[k] - want) <= abs(run[k] - weight[k] - want))
        todo += [(at[key < limit], first, n // 2), (at[key >= limit], first + n // 2, n - n // 2)]
    return out


def test_shards_plain(spark):
    for sf, shards in (("sf0.01", 7), ("sf0.1", 40)):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        known = metadata(docs).select("doc_id", "size", "text_crc32", "tie", *[f"c_{d}" for d in DIMENSIONS]).collect()
        want = plain_shards(np.array([[r["size"], r["tie"], *r[4:]] for r in known], np.int64), shards)
        got = kd_shards(docs, shards).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == Counter((r["doc_id"], r["size"], r["text_crc32"], int(s)) for r, s in zip(known, want, strict=True))
        filled = np.bincount([r["shard"] for r in got], weights=[r["size"] for r in got], minlength=shards)
        assert filled.max() - filled.min() <= 2 * max(r["size"] for r in got)
    assert filled.max() < 1.03 * filled.mean() and filled.min() > 0.97 * filled.mean()


def chain(matches, must):
    """The heaviest rising chain of (position, place), each next on a diagonal near the last one's: how many of MUST's places it has, and how many in all."""
    best = []
    for i, p in sorted(matches, key=lambda m: (m[0], -m[1])):
        before = [w for (j, q), w in best if j < i and q < p and abs((i - p) - (j - q)) <= NEIGHBOURS]
        had = max(before, default=(0, 0))
        best.append(((i, p), (had[0] + (p in must), had[1] + 1)))
    return max(w for _, w in best)


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    base = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    share, own = 0.0, set()
    for label, sentence in TEMPLATES.items():
        t = sentence.split()
        grams = [(t[p], t[p + 1]) for p in range(len(t) - 1)]
        must = {p for p, g in enumerate(grams) if " ".join(g) in MUST.get(label, [])}
        matches = [(i, p) for i in range(len(words) - 1) for p, g in enumerate(grams) if g == (words[i], words[i + 1])]
        spans, last = [], None
        for m in sorted(matches, key=lambda m: m[0] - m[1]):
            if last is None or m[0] - m[1] - last > NEIGHBOURS:
                spans.append([])
            spans[-1].append(m)
            last = m[0] - m[1]
        for s in spans:
            places = {p for _, p in s}
            if len(places) >= ENOUGH * len(grams) and must <= places:
                named, n = chain(s, must)
                if named >= len(must) and n >= ENOUGH * len(grams):
                    own.add(label)
                    share = max(share, n / len(grams))
    starts = [i for i, _ in base]
    labels = {b for _, b in base}
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | own)), 1.0 if base else share


def test_licenses_plain(spark):
    r = random.Random(4)
    vocabulary = sorted({w for t in [*TEMPLATES.values(), *PHRASES] for w in t.split()}) + ["x", "y"]
    texts = [None, "", "MIT", "cc by cc by cc BY"]
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 6)):
            t = r.choice([*TEMPLATES.values(), *PHRASES]).split()
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                k = r.randrange(len(t))
                t[k : k + 1] = r.choice([[], [r.choice(vocabulary)], [t[k], r.choice(vocabulary)], [t[k], t[k]]])
                t = t or ["x"]
            parts += t[r.randint(0, 2) :] + [r.choice(vocabulary) for _ in range(r.choice([0, 0, 2, 9]))]
        texts.append("".join((w.upper() if r.random() < 0.2 else w) + r.choice([" ", " ", ", ", "\n", "-"]) for w in parts))
    got = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(texts)
    for x in got:
        want = plain_scan(texts[x["doc_id"]])
        assert tuple(x[1:-1]) == want[:-1] and abs(x["score"] - want[-1]) < 1e-9, (texts[x["doc_id"]], x, want)
    assert sum(x["labels"] != x["base_labels"] for x in got) > 20 and len({x["score"] for x in got}) > 5


def fills(lengths, capacity):
    """The bins of best-fit decreasing, each as the lengths in it, sorted."""
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if sum(b) + x <= capacity]
        if fits:
            max(fits, key=sum).append(x)
        else:
            bins.append([x])
    return sorted(sorted(b) for b in bins)


def test_packing_plain():
    r = random.Random(1)
    for _ in range(200):
        lengths = [r.randint(1, r.choice([5, 20, 50])) for _ in range(r.randint(0, 90))]
        counts, bins = Counter(lengths), {}
        runs = sorted(pack_histogram(counts, 50), key=lambda x: (x[0], x[1]))
        for k, (length, rank, first, each, offset) in enumerate(runs):
            end = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == length else counts[length]
            for i in range(end - rank):
                bins.setdefault(first + i // each, []).append((offset + i % each * length, length))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 50
        assert sum(len(b) for b in bins.values()) == len(lengths)
        assert sorted(sum(x for _, x in b) for b in bins.values()) == sorted(map(sum, fills(lengths, 50)))
