"""The trie of conversations against a plain one, with nulls, ties, repeated rows, copies, long conversations, buckets of every kind and nothing at all."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from walflow.llm import prefix_trie as pt
from walflow.llm.prefix_trie import prefix_trie
from walflow.llm.queries import trie_report

SCHEMA = "conv_id long, turn int, role string, text string, id long, pos string, words string"


def plain(rows, opening):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {}
    for c, x in own.items():
        mine = [t[2:] for t in sorted(x)]
        base, h = opening(c)
        seqs[c] = [t[2:] for t in sorted(own.get(base, []))][:h] + mine[h:]
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out = set()
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode().split()) if node else 0)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(seqs[c]) == len(node))))
        out.add((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def contract(c):
    return (c - c % 20 if c >= 0 else c + -c % 20), zlib.crc32(str(c).encode()) % 4


def got(df):
    rows = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(seed, n=120):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), -5, -40, 2**53 + 1, 2**53 + 3, 2**62]:
        if r.random() < 0.1:
            continue
        same = r.choice([3, 7, None])
        for k in range(r.choice([1, 2, 3, 3, 5, 9])):
            turn = r.choice([k, k, k, None, 1])
            rows.append((c, turn, r.choice(["user", "assistant", None]), r.choice(["hello there", "a  b\tc", "", None, "Zürich x"]) if same is None else f"turn {k % same} of many"))
            if r.random() < 0.1:
                rows.append(rows[-1])
    long = [(500 + j, k, "user", f"t{k if k < 9 or j < 2 else k + j}") for j in range(5) for k in range(14)]
    return rows + long + [(None, 0, "user", "x"), (None, 1, "user", "y")] + [(1000 + k, 0, "user", "hello there") for k in range(60)]


@pytest.mark.parametrize("seed,local,block,ids", [(1, 50_000, 20_000, 10_000), (2, 40, 7, 3), (3, 1, 3, 1)])
def test_against_plain(spark, monkeypatch, seed, local, block, ids):
    monkeypatch.setattr(pt, "BLOCK", block)
    monkeypatch.setattr(pt, "HOT", 3)
    rows = made(seed) if local > 1 else made(seed, 20)[:60]
    df = spark.createDataFrame([(*r, 0, "p", None) for r in rows], SCHEMA).repartition(3)
    assert got(prefix_trie(df, local=local)) == plain(rows, lambda c: (c, 0))
    if local != 40:
        assert got(trie_report(df)) == plain(rows, contract)


def test_chunks_of_ids(spark, monkeypatch):
    rows = [(c, 0, "user", "same") for c in range(25_000)] + [(c, 0, "user", "other") for c in range(30_000, 30_003)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert got(prefix_trie(df)) == plain(rows, lambda c: (c, 0))


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(empty).count() == trie_report(empty).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "", "")], SCHEMA)).count() == 0
