"""doc_ids beside nulls: ids above 2**53, which a float cannot hold, come back as they are from every operator and stage; op1's draw does not depend on batches."""

from collections import Counter

import public_tokenizers
import pytest

from walflow.llm.exact_dedup import exact_duplicates, keep_first
from walflow.llm.importance import keep_good, resampled
from walflow.llm.jaccard_join import jaccard_components, keep_one_each
from walflow.llm.kd_search import nearest
from walflow.llm.kd_shards import kd_shards
from walflow.llm.licenses import license_scan
from walflow.llm.line_dedup import repeated_lines, without_repeated_lines
from walflow.llm.packing import packed
from walflow.llm.pieces import decoded, encoded
from walflow.llm.pii import find_pii, without_pii

BIG = 2**53
LINE = "the river runs past the old mill and under the bridge"
ROWS = [(None, "no id here"), (BIG + 1, f"one\n{LINE}"), (BIG + 3, f"two a@b.co\n{LINE}"), (2**63 - 1, None), (-(2**63), "x"), (None, None), (BIG + 5, f"{LINE} of stone"), (BIG + 7, f"{LINE} of stone")]
IDS = Counter(i for i, _ in ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).cache()


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_one_row_each(spark, docs):
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = encoded(docs, model)
    none = spark.createDataFrame([], "doc_id long, quality int")
    for got in (packed(docs, public_tokenizers.path("word_bpe_49k.json")), find_pii(docs), coded, decoded(coded, model), exact_duplicates(docs), license_scan(docs), kd_shards(docs, 2), jaccard_components(docs), resampled(docs, none), keep_good(docs, none), without_pii(docs), without_repeated_lines(docs)):
        assert ids(got) == IDS


def test_kept_rows(docs):
    assert ids(keep_first(docs)) == IDS - Counter([None, BIG + 7])
    assert ids(keep_one_each(docs)) == IDS - Counter([BIG + 7])
    assert {r["doc_id"]: r["component_id"] for r in jaccard_components(docs).collect() if r["doc_id"] and r["doc_id"] > BIG}[BIG + 7] == BIG + 5
    assert {(r["doc_id"], r["line"]) for r in repeated_lines(docs).collect()} == {(BIG + 3, 1), (BIG + 5, 0), (BIG + 7, 0)}


def test_vectors(spark):
    big = 100 * (BIG // 100 + 1)
    rows = [(None, [1.0, 0.0]), (big, [1.0, 2.0]), (big + 1, [3.0, 4.0]), (big + 3, [2.0**24, 0.001]), (big + 5, [2.0**24, 0.002])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(big, big + 5, 2**44 + 2 * 2048), (big, big + 3, 2**44 + 2048), (big, big + 1, 11 * 1024 * 1024)]


def test_draw_is_the_same_in_any_batch(spark):
    rows = [(None if i % 97 == 0 else BIG + i, ("good words here " if i % 3 else "bad words there ") * 3 + f"w{i % 50} v{i % 7}") for i in range(600)]
    labels = spark.createDataFrame([(BIG + i, int(i % 3 > 0)) for i in range(1, 300) if i % 97], "doc_id long, quality int")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    draws = []
    for parts, size in ((1, 10_000), (5, 7), (3, 64)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        d = frame.repartition(parts)
        scored = {(r["doc_id"], r["log_weight"], r["sampling_key"]) for r in resampled(d, labels).collect()}
        kept, drawn = ids(keep_good(d, labels)), ids(resampled(d, labels))
        assert kept == drawn and 0 < sum(kept.values()) < len(rows)
        draws.append((scored, kept))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert draws[0] == draws[1] == draws[2]
