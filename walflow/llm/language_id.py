"""Language identification by compression: a text belongs to the language whose dictionary lets zstandard write it in the fewest bytes.

A language's dictionary is raw content: passages of its labelled texts, lower-cased. They are a sample of at most BUCKETS passages of up to PASSAGE characters,
of which DICTIONARY bytes are used: of all passages of a language that fall into one of BUCKETS by their hash, the one with the least hash. Every passage of
every labelled text takes part in that, copies count once, and the least hashes are found by counts with map-side combine.

A text is compressed whole, in blocks of BLOCK bytes that start afresh from the dictionary, as a long text would otherwise become its own dictionary; matches
of three bytes count, which short texts need. Where the two smallest sizes are close, relative to the second, the answer is not accepted. Ties go to the
language with more labelled texts, then to the smaller name.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walflow.llm.common import dropped, saved, small_batches

BUCKETS, PASSAGE = 160, 400
DICTIONARY = 32 << 10
BLOCK = 2 << 10
MARGIN = 0.02
UNDETERMINED = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")


def fitted(examples: DataFrame) -> list[tuple[str, bytes]]:
    """(lang, dictionary) of examples (text, lang), the language with the most texts first. Null texts and langs take no part. The driver holds BUCKETS passages a language."""
    spark = examples.sparkSession
    known = examples.filter("text is not null and lang is not null")
    passages = known.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"(?s).{{1,{PASSAGE}}}"), F.lit(0))).alias("passage")).withColumn("h", F.xxhash64("passage"))
    least = saved(passages.groupBy("lang", F.pmod("h", F.lit(BUCKETS)).alias("bucket")).agg(F.min("h").alias("h")).select("lang", "h"), "language-passages")
    drawn = passages.join(F.broadcast(least), ["lang", "h"]).groupBy("lang", "h").agg(F.first("passage").alias("passage"))  # least has at most BUCKETS rows a language
    texts = known.groupBy("lang").count()
    with small_batches(spark):
        found = drawn.orderBy("lang", "h").collect()
        names = [r["lang"] for r in texts.orderBy(F.desc("count"), "lang").collect()]
    dropped(least)
    content: dict[str, bytes] = dict.fromkeys(names, b"")
    for r in found:
        content[r["lang"]] += r["passage"].encode("utf-8", "replace") + b"\n"
    return [(lang, content[lang][-DICTIONARY:]) for lang in names]


@lru_cache(maxsize=2)
def _compressors(models: tuple[tuple[str, bytes], ...]) -> list[zstandard.ZstdCompressor]:
    """One for each language, for all the tasks that a worker process runs."""
    settings = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, min_match=3, window_log=18, hash_log=16, chain_log=16, search_log=4, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    out = []
    for _, content in models:
        if len(content) < 8:  # too short to be a dictionary
            out.append(zstandard.ZstdCompressor(compression_params=settings))
            continue
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=settings)
        out.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=dictionary))
    return out


def sizes(text: str, compressors: list[zstandard.ZstdCompressor]) -> list[int]:
    """The bytes that the whole text takes with each dictionary."""
    raw = text.lower().encode("utf-8", "replace")
    blocks = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def identified(docs: DataFrame, models: list[tuple[str, bytes]], margin: float = MARGIN) -> DataFrame:
    """docs with a column `language`: best (the language of the smallest size), score (how much smaller than the second, 0 to 1), accepted (score at least margin).

    A text that is null or has no letter is UNDETERMINED with score 0, as is every text if no language was learned; with a single language the score is 1. A text's
    result depends on that text and the models alone; repeated rows and the other columns stay as they are. A column named language is replaced. Empty tables
    give empty results. A text is held whole by one worker, in batches of bounded bytes.
    """
    held = docs.sparkSession.sparkContext.broadcast(tuple(models))

    @F.pandas_udf("best string, score double, accepted boolean")
    def classify(texts: pd.Series) -> pd.DataFrame:
        names, compressors = [lang for lang, _ in held.value], _compressors(held.value)
        rows = []
        for t in texts:
            if not names or not has_letter(t):
                rows.append((UNDETERMINED, 0.0, False))
                continue
            size = sizes(t, compressors)
            (first, k), (second, _) = sorted((s, k) for k, s in enumerate([*size, 1 << 62]))[:2]
            score = 1 - first / second
            rows.append((names[k], score, score >= margin))
        return pd.DataFrame(rows, columns=["best", "score", "accepted"])

    return docs.withColumn("language", classify(F.col("text")))


def held_out_languages(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score, accepted. Documents whose crc32(doc_id) mod 4 is 2 are held out of the learning.

    Rows without doc_id are neither held out nor learned from. lang_pred is the best language even where it is not accepted.
    """
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    models = fitted(docs.filter(rest != 2).select("text", "lang"))
    found = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text"), models)
    return saved(found.select("doc_id", "held_out", F.col("language.best").alias("lang_pred"), "language.score", "language.accepted"), "languages")
