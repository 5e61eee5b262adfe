"""The pipeline and its stages on odd tables: clashing column names, nulls, repeated rows, ties, nothing at all; each held against a plain version."""

import json
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_llm import ROWS, norm, shingles
from tokenizers import Tokenizer

import corpus_pipeline
from walflow.llm import tagger
from walflow.llm.exact_dedup import keep_first
from walflow.llm.importance import keep_good, resampled
from walflow.llm.jaccard_join import keep_one_each
from walflow.llm.line_dedup import repeated_lines, without_repeated_lines
from walflow.llm.pii import KINDS, all_spans, without_pii

CLASHING = ["row", "new", "key", "gone", "_rows", "_keep", "_full", "_key", "_gone", "h", "maybe", "sha", "uid", "a.b", "c`d", "fold", "rank", "times", "kept_key", "n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASHING)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", None, len(t) if t else None, *[f"{c}{k}" for c in CLASHING]) for k, (i, t) in enumerate(ROWS)], SCHEMA).repartition(3).cache()


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def components(rows):
    """The component number of each row, by comparing all rows."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    return [find(x) for x in range(len(rows))], sets


def left_of_groups(rows):
    """How many rows of each doc_id keep_one_each leaves."""
    comp, sets = components(rows)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            least[comp[k]] = min(least.get(comp[k], i), i)
    return Counter(least.values()) + Counter(i for k, (i, _) in enumerate(rows) if not sets[k] or i is None)


def test_stages_keep_columns(spark, odd):
    for stage in (keep_first, keep_one_each, without_pii, without_repeated_lines):
        got = stage(odd)
        assert got.columns == odd.columns
        for r in got.collect():
            assert len({r[c].removeprefix(c) for c in CLASHING}) == 1  # a row's columns stay together
    labels = spark.createDataFrame([(10, 1), (11, 0)], "doc_id long, quality int")
    assert keep_good(odd, labels).columns == odd.columns


def test_stages_of_nothing(spark, odd):
    none = odd.limit(0)
    for stage in (keep_first, keep_one_each, without_pii, without_repeated_lines, lambda d: keep_good(d, spark.createDataFrame([], "doc_id long, quality int"))):
        assert stage(none).count() == 0 and stage(none).columns == odd.columns


def test_one_of_each_component(odd):
    assert Counter(r["doc_id"] for r in keep_one_each(odd).collect()) == left_of_groups(ROWS)


def test_shared_doc_ids(spark):
    """A doc_id with texts of several components stays in those of which it is the smallest."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (2, long + " x"), (2, "quite another text of seven words here"), (3, "quite another text of seven words here"), (2, "q w e r t y u"), (2, "q w e r t y u"), (4, ""), (4, "")]
    got = texts(keep_one_each(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == Counter({(1, long): 1, (2, rows[2][1]): 1, (2, "q w e r t y u"): 1, (4, ""): 2})


def test_lines_against_all_pairs(spark):
    """Lines drawn from few templates with words changed, so that sizes, places and ties of rarity vary."""
    import random

    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(3, 40))] for _ in range(25)]

    def line():
        w = list(r.choice(base))
        for _ in range(r.randint(0, max(1, len(w) // 6))):
            k = r.randrange(len(w))
            w[k : k + r.randint(0, 1)] = r.choices([*vocabulary, f"u{r.random()}"], k=r.randint(0, 2))
        return " ".join(w)

    rows = [(i, "\n".join(line() for _ in range(r.randint(0, 9)))) for i in range(120)]
    got = {(x["doc_id"], x["line"]) for x in repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    seen, want = [], set()
    for i, t in rows:
        for k, x in enumerate(t.split("\n")):
            s = set(x.split())
            if s and any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                want.add((i, k))
            if s:
                seen.append(s)
    assert got == want and len(want) > 100


def plain_tags(text, w):
    """The tags of a text by every window, its averaged scores and one path from end to end, in plain loops."""
    blocks = -(-len(text) // 64)
    codes = np.full((blocks + 1) * 64, tagger.CODES[tagger.PAD], np.uint8)
    codes[32 : 32 + len(text)] = tagger.encoded(text)
    score, total = np.zeros((len(codes), tagger.TAGS)), np.zeros((len(codes), 1))
    for j in range(blocks):
        s = tagger.emissions(w, codes[None, j * 64 : j * 64 + 128])[0]
        for t in range(128):
            score[j * 64 + t] += s[t] * (min(t, 127 - t) + 0.5)
            total[j * 64 + t] += min(t, 127 - t) + 0.5
    return tagger.best_tags(w, (score / total)[None].astype(np.float32))[0][32 : 32 + len(text)]


def test_windows_against_whole_texts():
    """Texts full of digits are one stretch: tags are those of the whole text; elsewhere spans agree with decoding every window."""
    w, rng = tagger.trained(), np.random.default_rng(5)
    from walflow.llm.pii import tagged_spans

    made = [tagger.labelled(rng)[0] for _ in range(60)]
    some = [" 7 ".join(made[k : k + 6]) for k in range(0, 60, 6)]
    same = 0
    for text, got in zip(some, tagged_spans(some, w), strict=True):
        t = plain_tags(text, w)
        starts = {i for i in range(len(t)) if t[i] > 0 and (t[i] % 2 == 1 or i == 0 or (t[i - 1] - 1) // 2 != (t[i] - 1) // 2 or t[i - 1] == 0)}
        assert {a for _, a, _ in got} <= starts
        same += len({a for _, a, _ in got}) / max(1, len([a for a in starts if re.search("[0-9@]", text[a : a + 60])]))
    assert same / len(some) > 0.7


def test_card_and_phone():
    import random

    r = random.Random(6)
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(d):
        total = 0
        for k, c in enumerate(reversed(d)):
            v = int(c) * (2 if k % 2 else 1)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    from walflow.llm.pii import base_spans

    seen = Counter()
    for _ in range(4000):
        t = "".join(r.choice("0123456789 -+().a") for _ in range(r.randint(0, 60)))
        if r.random() < 0.3:
            t += " 4111 1111-11111111 " + t[:5]
        want = [(2, *m.span()) for m in card.finditer(t) if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
        want += [(3, *m.span()) for m in phone.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert [s for s in base_spans(t) if s[0] > 1] == sorted(want, key=lambda s: (s[1], s[0]))
        seen.update(k for k, *_ in want)
    assert min(seen[2], seen[3]) > 100


def test_planted_documents():
    """On the driver's documents: every password, token and access key that a plain pattern finds is tagged, and hardly anything else is."""
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    secret = re.compile(r"\bAKIA[0-9A-Z]{16}\b|(?<=password=)[0-9a-f]{16,}|(?<=token = \")[0-9a-f]{24,}")
    there = caught = extra = 0
    for t, (base, spans) in zip(docs, all_spans([t or "" for t in docs], tagger.trained()), strict=True):
        want = [m.span() for m in secret.finditer(t or "")]
        there += len(want)
        caught += sum(any(a < e and s < b for _, a, b in spans) for s, e in want)
        extra += sum(k == KINDS.index("key") and not any(a < e and s < b for s, e in want) for k, a, b in spans)
    assert there > 10 and caught >= 0.9 * there and extra <= 0.1 * there


def test_resampling_by_hand(spark):
    """Log weights, counts and the drawn set against sums in plain Python over the operator's own features."""
    import random

    from walflow.llm.importance import BUCKETS, FOLDS, PRIOR, SMOOTHING, WHOLE, ngrams

    r = random.Random(14)
    rows = [(i, " ".join(r.choice(["good", "fine", "text", "and", f"g{r.randrange(40)}"] if i % 3 else ["BUY!!", "NOW!!", f"b{r.randrange(40)}"]) for _ in range(30))) for i in range(150)]
    rows += [(500 + i, rows[1][1]) for i in range(20)] + [(None, "and good"), (600, None), (601, "")]
    labels = {i: int(i % 3 > 0) for i in range(0, 150, 2)}
    got = {(x["doc_id"], round(x["log_weight"], 6)): x for x in resampled(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    grams = [ngrams([t or ""])[1].tolist() for _, t in rows]
    raw, good = [SMOOTHING] * BUCKETS, [0.0] * BUCKETS
    for t in {norm(t): k for k, (_, t) in enumerate(rows)}.values():
        for b in grams[t]:
            raw[b] += 1
    shares = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        if i in labels:
            shares[norm(t)].append((k, labels[i]))
    for own in shares.values():
        for b in grams[own[0][0]]:
            good[b] += int(sum(g for _, g in own) * WHOLE / len(own)) / WHOLE
    n, total = sum(raw), sum(good)
    target = [g + PRIOR * x / n for g, x in zip(good, raw, strict=True)]
    ratio = np.log(np.array(target) / (total + PRIOR)) - np.log(np.array(raw) / n)
    weight = [float(sum(ratio[b] for b in g)) for g in grams]
    hashed = {(r[0], r[1]): r[2] % 2**64 for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(1, doc_id is null, doc_id, coalesce(text, ''))").collect()}
    key = [w - np.log(-np.log((hashed[x] + 0.5) / 2.0**64)) for w, x in zip(weight, rows, strict=True)]
    drawn = {(i, round(w, 6)) for w, (i, _) in zip(weight, rows, strict=True)} & set(got)
    assert len(drawn) == len(got) and FOLDS > 1
    least = min(x["sampling_key"] for x in got.values())
    for w, k, (i, _) in zip(weight, key, rows, strict=True):
        assert (k >= least - 1e-4) == ((i, round(w, 6)) in got)


def test_pipeline(spark, odd, tmp_path):
    """The chain on an odd table, stage by stage against plain versions of what each keeps of its predecessor's rows."""
    sf = f"file://{tmp_path}"
    odd.write.parquet(f"{sf}/documents.parquet")
    labels = [(i, int(k % 2)) for k, (i, _) in enumerate(ROWS) if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    docs, drawn = spark.read.parquet(f"{sf}/documents.parquet"), None
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
        kept.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    drawn = Counter(r["doc_id"] for r in resampled(odd, spark.read.parquet(f"{sf}/labels.parquet")).collect())
    assert Counter(i for i, _ in kept[0]) == drawn
    least = {}
    for i, t in kept[0]:
        least[norm(t)] = min(least.get(norm(t), (True, 0)), (i is None, i or 0))
    assert Counter((norm(t), (i is None, i or 0)) for i, t in kept[1]) == Counter(least.items())
    assert Counter(i for i, _ in kept[2]) == left_of_groups(kept[1])
    assert [i for i, _ in sorted(kept[3], key=str)] and Counter(i for i, _ in kept[3]) == Counter(i for i, _ in kept[2])
    w = tagger.trained()
    for i, t in kept[3]:
        assert not all_spans([t or ""], w)[0][1]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, sf).collect()
    want = Counter(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in kept[3])
    lengths = defaultdict(int)
    for r in got:
        lengths[r["doc_id"]] += r["length"]
    assert sum(n * c for n, c in want.items()) == sum(lengths.values()) and json.dumps(sorted(map(str, lengths)))


def test_pipeline_of_nothing(spark, odd, tmp_path):
    sf = f"file://{tmp_path}"
    odd.limit(0).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
