"""What the joins of texts and lines shuffle: never the texts of rows that only pass through."""

import random
from collections import Counter
from contextlib import contextmanager

import pytest

from walflow.llm.jaccard_join import keep_one_each
from walflow.llm.line_dedup import repeated_lines


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def written(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}


@contextmanager
def shuffled(spark, out):
    """Adds to out the bytes that stages begun inside have written to shuffles."""
    before = written(spark)
    yield
    out.append(sum(n for k, n in written(spark).items() if k not in before))


def noise(r, n):
    """One word that does not compress."""
    return "".join(map(chr, (r.randrange(0x4E00, 0x9FFF) for _ in range(n))))


def test_kept_texts_stay_where_they_are(spark, no_broadcast):
    r = random.Random(3)
    rows = [(i, noise(r, 20_000)) for i in range(60)]
    rows += [(100, rows[0][1]), (101, "a b c d e f"), (101, "a b c d e f"), (None, rows[1][1]), (103, ""), (104, None)]
    docs, moved = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint(), []
    with shuffled(spark, moved):
        got = Counter(map(tuple, keep_one_each(docs).collect()))
    assert got == Counter(rows[:60] + [(101, "a b c d e f"), (None, rows[1][1]), (103, ""), (104, None)])
    assert moved[0] < sum(len((t or "").encode()) for _, t in rows) / 4


def test_only_lines_in_question_move(spark, no_broadcast):
    """Of a document with one similar line the other lines are not shuffled."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(12)]
    rows = [(i, "\n".join([noise(r, 20_000), " ".join([*words[:11], f"u{i}"]), noise(r, 20_000)])) for i in range(40)]
    docs, moved = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint(), []
    with shuffled(spark, moved):
        got = sorted((x["doc_id"], x["line"]) for x in repeated_lines(docs).collect())
    assert got == [(i, 1) for i in range(1, 40)]
    assert moved[0] < sum(len(t.encode()) for _, t in rows) / 4
