"""Runs of periodic words against a plain search, the query's rebuilt texts against its contract, and language identification on held-out documents."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from walflow.llm.language_id import BLOCK, UNDETERMINED, fitted, has_letter, held_out_languages, identified
from walflow.llm.periodic_runs import collapsed, periodic_runs, runs_of, word_runs
from walflow.llm.queries import periodic_texts, run_report


def plain_runs(x):
    """(start, end, smallest period) by trying all periods."""
    found = {}
    for p in range(1, len(x) // 4 + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found[i, j + p] = min(p, found.get((i, j + p), p))
            i = max(j, i + 1)
    return sorted(((s, e, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def sequence(r):
    if r.random() < 0.4:
        k = r.choice([1, 2, 2, 3])
        return [r.randrange(k) for _ in range(r.randint(0, 60))]
    x = []
    while len(x) < 50:
        x += [r.randrange(3) for _ in range(r.randint(1, 5))] * r.randint(1, 7)
        x += x[: r.randint(0, len(x))] if r.random() < 0.3 else []
        x = x * 2 if r.random() < 0.2 else x
    return x[:200]


def test_runs():
    r = random.Random(1)
    for _ in range(4000):
        x = sequence(r)
        words = [b"w%d" % i for i in x]
        runs = plain_runs(x)
        assert runs_of(x) == word_runs(words) == runs
        drop = {i for s, e, p in runs for i in range(s + p, e)}
        assert collapsed(words, runs) == b" ".join(w for i, w in enumerate(words) if i not in drop)
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert runs_of(b * 5) == plain_runs(b * 5)
    assert runs_of([7] * 200_000) == [(0, 200_000, 1)]


def contract(doc, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    runs = plain_runs([names[w] for w in words])
    best = max(((e - s, -s, -p) for s, e, p in runs), default=None)
    top = (-best[1], best[0], -best[2], 1000 * best[0] // -best[2]) if best else (None,) * 4
    drop = {i for s, e, p in runs for i in range(s + p, e)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc, len(runs), *top, sha("".join(f"{s},{e - s},{p}\n" for s, e, p in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_report(spark):
    r = random.Random(2)
    texts = [None, "", " \t\n ", "a", "a a a a a a", "x\x0by\x0cz\r\n é é é é é é  é é", "日本 日本 日本 日本 日本 日本"]
    texts += [" ".join(f"w{i}" for i in sequence(r)) for _ in range(60)] + ["\n".join(f"v{r.randrange(40)}" for _ in range(r.randint(1, 300))) for _ in range(60)]
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(texts * 3)] + [(None, "b " * 9, "x", "y", 1), (None, None, "", "", 1), (2**53 + 1, "q " * 70_000, "", "", 2), (-3, "u v " * 20, "", "", 2), (4, "u v " * 20, "", "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, `best` string, h int").repartition(4)
    got = Counter(tuple(x) for x in run_report(df).select(*COLUMNS).collect())
    short = [(i, t) for i, t, *_ in rows if len(t or "") < 10_000]
    assert got - Counter(contract(*x) for x in short) == Counter([(2**53 + 1, 1, 0, 70_000, 1, 70_000_000, hashlib.sha256(b"0,70000,1\n").hexdigest(), hashlib.sha256(b"q").hexdigest())])
    assert sum(got.values()) == len(rows)
    assert run_report(df.limit(0)).count() == 0
    kept = periodic_runs(df)
    assert set(kept.columns) == {"doc_id", "text", "runs", "best", "h", "collapsed"} and {x["h"] for x in kept.collect()} == {1, 2}


def test_rebuilt_texts(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(400)]
    some = 0
    for x in periodic_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        h, words = zlib.crc32(str(x["doc_id"]).encode()), rows[x["doc_id"]][1].split()
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            some += 1
        assert x["text"].split() == words
    assert some > 20


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.97), ("sf0.1", 0.99)])
def test_languages_held_out(spark, sf, least):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = held_out_languages(docs).alias("g").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    langs = {r["lang"] for r in got}
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] in langs if has_letter(r["text"]) else r["lang_pred"] == UNDETERMINED for r in got)
    held = [r for r in got if r["held_out"] and r["lang"] and has_letter(r["text"])]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > least * len(held)
    wrong = [r for r in held if r["lang"] != r["lang_pred"]]
    assert len(wrong) < 5 or sum(not r["accepted"] for r in wrong) >= 0.5 * len(wrong)


def test_languages_of_odd_texts(spark):
    english, german = "the cat sat on the mat and the dog lay by the door ", "der hund lag vor der tür und die katze auf der matte "
    rows = [(i, english * 3 + f"number {i}", "en") for i in range(1, 40)] + [(i, german * 3 + f"zahl {i}", "de") for i in range(40, 60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !? ½ ²", "xx"), (103, german * 4000, None), (104, None, None), (None, english, "de"), (None, None, None), (105, "日本語", None), (2**53 + 1, german, None), (2**53 + 1, german, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in held_out_languages(df).collect()}
    assert held_out_languages(df).count() == len(rows)
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 104)] == [UNDETERMINED] * 4 and got[104]["score"] == 0
    assert got[103]["lang_pred"] == "de" and got[103]["accepted"] and got[2**53 + 1]["lang_pred"] == "de" and got[7]["lang_pred"] == "en"
    assert len(german * 4000) > 50 * BLOCK
    assert {r["lang_pred"] for r in held_out_languages(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {UNDETERMINED}
    assert held_out_languages(df.limit(0)).count() == 0
    models = fitted(df.filter("lang = 'en'").select("text", "lang"))
    one = identified(df.withColumn("best", df["doc_id"]), models)
    assert one.columns == ["doc_id", "text", "lang", "best", "language"] and {(r["language"]["best"], r["language"]["score"]) for r in one.filter("text like '%cat%'").collect()} == {("en", 1.0)}


def test_dictionary_of_copies(spark):
    """A third of all texts being one text leaves the dictionary as it is."""
    rows = [(f"word{i} " * 30 + "and so on", "en") for i in range(200)]
    few = fitted(spark.createDataFrame(rows, "text string, lang string"))
    many = fitted(spark.createDataFrame(rows + [rows[0]] * 100, "text string, lang string").repartition(5))
    assert few == many and len(few[0][1]) > 10_000
