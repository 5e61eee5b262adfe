"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k over the log weights.

The target model counts the n-grams of labelled good documents, a sample of at most SAMPLE labels; the raw model counts those of all documents. Both
count a text once, however many rows hold it (with exact dedup's equality), so that copying a document does not change its weight; in the target model
a text counts by the share of its labelled rows that are good. Copies are found with exact dedup's Bloom filter, so that only their rows shuffle. A document's log weight is the
sum over its n-grams of log p_target - log p_raw, with n-grams hashed into BUCKETS: words, pairs of words, and pairs of word shapes (case, last sign, whether
the word has just occurred). k documents are drawn without replacement by adding Gumbel noise to the log weights and
taking the k largest; k is the number of documents whose weight is above the line that best parts the labelled sample. The line is fitted on weights that
each labelled text has by a target model without its own fold of the labelled texts, as a text's weight is too high by a model that has counted it.

The noise comes from a hash of doc_id and text that Spark makes, so a row has the same wherever and beside whatever it is drawn. The k-th largest key is found
from bin counts, without a sort.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walflow.llm.common import dropped, named_row, saved, small_batches, unnamed_row, weighted_cuts
from walflow.llm.exact_dedup import as_column, normalised, repeat_test
from walflow.llm.words import MULTIPLIER, edges, in_parts, joined, stretch_hashes, windows

BUCKETS = 1 << 15
SAMPLE = 20_000
FOLDS = 10
SMOOTHING = 0.5
WHOLE = 1 << 16  # the target's counts are whole numbers of 1 / WHOLE, so that sums are the same in any order
PRIOR = 100_000  # n-grams' worth of the raw model mixed into the target's counts, so that few labels say little about rare n-grams
KEY_BITS, KEY_SCALE, REST_BITS = 44, 1 << 16, 40  # keys are ordered by whole parts of 1 / KEY_SCALE, and within one of these by REST_BITS more

_SPACE = re.compile(rb"[\x09-\x0D\x1C-\x20]")
#: Of each byte: upper case 1, lower case 2 (and all of other scripts), digit 4, white space 8, anything else 0.
_KIND = np.array([1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b > 127 else 4 if 48 <= b <= 57 else 8 if _SPACE.match(bytes([b])) else 0 for b in range(256)], np.uint8)
_SIGN = np.where(_KIND == 0, np.cumsum(_KIND == 0), 0)  # numbers the signs that may end a word, from 1


def words_of(window: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and shape of each word of a stretch of UTF-8 that no word crosses.

    Words stand between ASCII white space. The hash is that of the word with A-Z lower-cased and without up to four ASCII signs at its end (all of it, if
    nothing else is left); the shape, below 256, is made of its case and the sign it ends in.
    """
    raw = np.frombuffer(window, np.uint8)
    kind = _KIND[raw]
    start, end = edges(kind == 8)
    if not len(start):
        return start, np.zeros(0, np.uint64), start
    core = end.copy()
    for _ in range(4):
        core -= (core > start) & (kind[core - 1] == 0)
    kinds = np.bitwise_or.reduceat(kind & 7, start)
    case = np.select([(kinds & 3 == 1) & (core - start > 1), kind[start] == 1, kinds & 3 == 2, kinds == 4], [0, 1, 2, 3], 4)
    core = np.where(core == start, end, core)
    return start, stretch_hashes(raw, start, core), case * 51 + np.minimum(_SIGN[raw[end - 1]], 50)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each n-gram of the texts. The bytes are gone through in windows, so that little beside the words is held."""
    whole, begins = joined(texts)
    found = [(start + at, h, shape) for at, window in windows(whole, _SPACE) for start, h, shape in [words_of(window)]]
    if not sum(len(f[0]) for f in found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, h, shape = (np.concatenate(x) for x in zip(*found, strict=True))
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, np.r_[begins, len(whole)])))
    n = len(h)
    for back in (1, 2, 3):
        again = np.zeros(n, bool)
        again[back:] = (h[back:] == h[:-back]) & (doc[back:] == doc[:-back])
        shape[again] |= 256
    with np.errstate(over="ignore"):
        mul = np.uint64(MULTIPLIER)
        pair = doc[1:] == doc[:-1]
        one = h * mul
        two = (one[:-1] ^ h[1:]) * mul
        form = ((shape[:-1] * 512 + shape[1:]).astype(np.uint64) + np.uint64(1 << 40)) * mul
        bucket = np.concatenate([one, two[pair], form[pair]]) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    later = doc[1:][pair]
    return np.concatenate([doc, later, later]), bucket.astype(np.int64)


def label_sample(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, good: at most `most` labelled documents, the same whatever the order of the rows. Null and conflicting labels take no part."""
    one = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).filter("lo = hi")
    return one.select("doc_id", (F.col("lo") > 0).alias("good"), F.xxhash64("doc_id").alias("at")).orderBy("at", "doc_id").limit(most).select("doc_id", "good")


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and 128 bits of hash by which rows hold the same text or not; the n-grams of rows with equal hashes are the same."""
    same = normalised(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(same).alias("h"), F.xxhash64(F.lit(1), same).alias("h2"))


def raw_counts(docs: DataFrame) -> np.ndarray:
    """The n-grams of docs by bucket, each text counted once. Texts whose hash occurs once are counted where they are; of the others one row a text and task shuffles."""
    hashed = _hashed(docs)
    hashes = saved(hashed.select("h"), "importance-hashes")
    test = repeat_test(hashes, hashes.count())
    one = {"weight": F.lit(1).cast("long"), "kind": F.lit(0)}
    again = saved(hashed.filter(as_column(test)).groupBy("h", "h2").agg(F.first("text").alias("text")), "importance-copies")
    out = _counted(hashed.withColumns(one), 1, test)[0] + _counted(again.withColumns(one), 1)[0]
    dropped(hashes)
    dropped(again)
    return out


def _counted(texts: DataFrame, kinds: int, left_out: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """For each kind the number of n-grams by bucket, of texts (text, weight, kind, h); without those for whose h left_out is true."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((kinds, BUCKETS), np.int64)
        for batch in batches:
            if left_out:
                batch = batch[~left_out(batch["h"].to_numpy())]
            weight, kind = batch["weight"].to_numpy(np.int64), batch["kind"].to_numpy(np.int64)
            for first, some in in_parts([t or "" for t in batch["text"]]):
                doc, bucket = ngrams(some)
                for k, w in {(k, w) for k, w in zip(kind[first : first + len(some)].tolist(), weight[first : first + len(some)].tolist(), strict=True)}:
                    own = (kind[first + doc] == k) & (weight[first + doc] == w)
                    sums[k] += w * np.bincount(bucket[own], minlength=BUCKETS)
        found = np.flatnonzero(sums.any(0))
        yield pd.DataFrame({"bucket": found} | {f"n{k}": sums[k][found] for k in range(kinds)})

    names = [f"n{k}" for k in range(kinds)]
    parts = texts.select("text", "weight", "kind", "h").mapInPandas(count, ", ".join(f"{c} long" for c in ["bucket", *names]))
    out = np.zeros((kinds, BUCKETS), np.int64)
    with small_batches(texts.sparkSession):
        for r in parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).collect():  # at most BUCKETS rows
            out[:, r["bucket"]] = r[1:]
    return out


def labelled_rows(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, text, good, h, h2, fold of the rows of docs that the sample labels. Copies of a text are in one fold."""
    return _hashed(docs).join(F.broadcast(sample), "doc_id").withColumn("fold", F.pmod("h2", F.lit(FOLDS)).cast("int"))


def log_ratios(docs: DataFrame, labelled: DataFrame) -> np.ndarray:
    """log p_target - log p_raw for each bucket, by the target model without fold 0, 1, ..., and last by the whole one; all zero without a good label."""
    share = F.floor(F.count_if("good") * WHOLE / F.count(F.lit(1))).cast("long")
    good = labelled.groupBy("h", "h2").agg(F.first("text").alias("text"), share.alias("weight"), F.first("fold").alias("kind")).filter("weight > 0")
    sums = _counted(good, FOLDS)
    ratios = np.zeros((FOLDS + 1, BUCKETS))
    if not sums.any():
        return ratios
    raw = SMOOTHING + raw_counts(docs)
    for k in range(FOLDS + 1):
        target = (sums.sum(0) - (sums[k] if k < FOLDS else 0)) / WHOLE
        if target.any():
            target = target + PRIOR * raw / raw.sum()
            ratios[k] = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return ratios


def _scorer(docs: DataFrame, ratios: np.ndarray, seed: int):
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.pandas_udf("n_ngrams long, log_weight double, sampling_key double")
    def score(noise: pd.Series, text: pd.Series, fold: pd.Series) -> pd.DataFrame:
        texts, folds = [t or "" for t in text], fold.to_numpy(np.int64)
        n, w = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for at, some in in_parts(texts):
            doc, bucket = ngrams(some)
            n[at : at + len(some)] = np.bincount(doc, minlength=len(some))
            w[at : at + len(some)] = np.bincount(doc, weights=held.value[folds[at + doc], bucket], minlength=len(some))
        u = (noise.to_numpy(np.int64).view(np.uint64).astype(np.float64) + 0.5) / 2.0**64
        return pd.DataFrame({"n_ngrams": n, "log_weight": w, "sampling_key": w - np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))})

    noise = lambda doc_id, text: F.xxhash64(F.lit(seed), doc_id.isNull(), doc_id.cast("long"), F.coalesce(text, F.lit("")))
    return lambda doc_id, text, fold=None: score(noise(doc_id, text), text, F.lit(FOLDS) if fold is None else fold)


def dividing_line(weights: np.ndarray, good: np.ndarray) -> float:
    """The log weight above which the labelled sample is parted with the fewest errors, each class counted by its share; all pass without both classes."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost, caught = np.r_[0, np.cumsum(g)] / g.sum(), np.r_[0, np.cumsum(~g)] / (~g).sum()
    cut = int(np.argmax(caught - 3 * lost))  # losing a good document weighs three times as much
    return float((w[cut - 1] + w[cut]) / 2) if 0 < cut < len(w) else (-np.inf if cut == 0 else np.inf)


def _key_parts(key: Column) -> tuple[Column, Column]:
    """A sampling key as two whole numbers, each from 0 and the smaller the larger the key; both steps are exact, being by powers of two."""
    half = 1 << (KEY_BITS - 1)
    whole = F.greatest(F.least(F.floor(key * KEY_SCALE), F.lit(half - 1)), F.lit(1 - half))
    rest = F.greatest(F.least(F.floor((key * KEY_SCALE - whole) * (1 << REST_BITS)), F.lit((1 << REST_BITS) - 1)), F.lit(0))
    return (F.lit(half) - whole).cast("long"), (F.lit((1 << REST_BITS) - 1) - rest).cast("long")


def _drawing(docs: DataFrame, labels: DataFrame, seed: int, sample: int):
    """The score function, all rows' scores (saved), and which sampling keys are drawn."""
    labelled = saved(labelled_rows(docs, saved(label_sample(labels, sample), "importance-labels")), "importance-labelled")
    score = _scorer(docs, log_ratios(docs, labelled), seed)
    given = F.col("doc_id").cast("long")
    scores = saved(docs.select(given.alias("doc_id"), score(given, F.col("text")).alias("s")).select("doc_id", "s.*"), "importance-scores")
    own = score(F.col("doc_id"), F.col("text"), F.col("fold"))["log_weight"].cast("decimal(28,6)")  # sums are the same in any order
    with small_batches(docs.sparkSession):
        fit = labelled.select("doc_id", "good", own.alias("w")).groupBy("doc_id", "good").agg(F.avg("w").cast("double").alias("log_weight")).toPandas()  # at most `sample` rows
    line = dividing_line(fit["log_weight"].to_numpy(float), fit["good"].to_numpy(bool))
    k = scores.filter(F.col("log_weight") > line).count() if np.isfinite(line) else scores.count() * int(line < 0)
    if not k:
        return score, scores, lambda key: F.lit(False)
    whole, rest = _key_parts(F.col("sampling_key"))
    cut, above, _ = weighted_cuts(scores, F.lit(0), whole, F.lit(1), {0: k}, KEY_BITS + 1)[0]
    last = weighted_cuts(scores.filter(whole == cut), F.lit(0), rest, F.lit(1), {0: k - above}, REST_BITS)[0][0]

    def drawn(key: Column) -> Column:
        whole, rest = _key_parts(key)
        return (whole < cut) | ((whole == cut) & (rest <= last))

    return score, scores, drawn


def resampled(docs: DataFrame, labels: DataFrame, seed: int = 1, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that are drawn: doc_id, n_ngrams, log_weight, sampling_key, kept (true).

    Null text is empty and weighs 0, like a text of unknown worth. Rows with the same doc_id and text have the same key and are drawn together, as are rows
    tied with the k-th. Without labels of both kinds every row is drawn. Empty tables give empty results. Only text, doc_id and labels are read.
    """
    _, scores, drawn = _drawing(docs, labels, seed, sample)
    return scores.filter(drawn(F.col("sampling_key"))).withColumn("kept", F.lit(True))


def keep_good(docs: DataFrame, labels: DataFrame, seed: int = 1, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that resampled() draws, all columns unchanged, whatever their names; scored again on the way, which spares a join by row.

    Nulls, ties, repeated rows and empty tables are as in resampled().
    """
    score, _, drawn = _drawing(docs, labels, seed, sample)
    keyed = named_row(docs).withColumn("key", score(F.col("row.doc_id").cast("long"), F.col("row.text"))["sampling_key"])
    return unnamed_row(keyed.filter(drawn(F.col("key"))), docs.columns)
