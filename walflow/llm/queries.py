"""The driver's queries for the corpus operators and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walflow.llm.common import saved, table
from walflow.llm.exact_dedup import exact_duplicates
from walflow.llm.importance import resampled
from walflow.llm.jaccard_join import jaccard_components
from walflow.llm.kd_search import nearest
from walflow.llm.kd_shards import kd_shards
from walflow.llm.language_id import held_out_languages
from walflow.llm.licenses import license_scan
from walflow.llm.line_dedup import line_report
from walflow.llm.packing import packed
from walflow.llm.periodic_runs import periodic_runs
from walflow.llm.pieces import encoded
from walflow.llm.pii import find_pii
from walflow.llm.prefix_trie import prefix_trie, shared_openings


def periodic_texts(docs: DataFrame) -> DataFrame:
    """docs in which the words of every tenth document, by the hash h of its doc_id, repeat from a place and with a period that h names."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    trimmed = F.regexp_replace("text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    words = F.split(trimmed, r"[\x20\x09-\x0D]+", -1)
    n = F.size(words)
    a = (g % n).cast("int")
    period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice(words, a + 1, period), F.ceil((n - a) / period).cast("int")))
    rebuilt = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(repeated, F.lit(1), n - a)), " ")
    return docs.withColumn("text", F.when((h % 10 == 0) & (trimmed != ""), rebuilt).otherwise(F.col("text")))


def run_report(docs: DataFrame) -> DataFrame:
    """periodic_runs() of periodic_texts() as digests, one row per row of docs. Rows without doc_id keep their texts."""
    found = saved(periodic_runs(periodic_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))).select("doc_id", "runs", F.sha2("collapsed", 256).alias("collapsed_sha256")), "periodic-runs")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("first"), (-r["period"]).alias("short"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    length, period = F.col("best.length"), -F.col("best.short")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.first")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256",
    )


def trie_report(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that begin with up to three turns of every twentieth."""
    conv = F.col("conv_id")
    return prefix_trie(conversations, lambda rows, convs: shared_openings(rows, convs, conv - conv % 20, (F.crc32(conv.cast("string")) % 4).cast("int"), 3))


QUERIES = {
    "op1_importance_resampling": lambda spark, d: resampled(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_kd_tree_shards": lambda spark, d: kd_shards(table(spark, d, "documents"), 40),
    "op3_best_fit_packing": lambda spark, d: packed(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json")),
    "op4_license_scan": lambda spark, d: license_scan(table(spark, d, "documents")),
    "op5_exact_dedup": lambda spark, d: exact_duplicates(table(spark, d, "documents")),
    "op6_jaccard_join": lambda spark, d: jaccard_components(table(spark, d, "documents")).drop("class_id"),
    "op7_kd_tree_search": lambda spark, d: nearest(table(spark, d, "embeddings")),
    "op8_sentence_pieces": lambda spark, d: encoded(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model")).drop("ids"),
    "op9_line_dedup": lambda spark, d: line_report(table(spark, d, "documents")),
    "op10_pii": lambda spark, d: find_pii(table(spark, d, "documents")),
    "op11_compression_language": lambda spark, d: held_out_languages(table(spark, d, "documents")),
    "op12_periodic_runs": lambda spark, d: run_report(table(spark, d, "documents")),
    "op13_prefix_trie": lambda spark, d: trie_report(table(spark, d, "conversations")),
}

ORACLE_SQL = {
    "op13_prefix_trie": r"""
        WITH own AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
                length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (
            SELECT conv_id, conv_id - conv_id % 20 AS base,
                xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS UBIGINT)), lambda h, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * CAST(3988292384 AS UBIGINT)),
                    xor(h, b)), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) % 4 AS h
            FROM (SELECT DISTINCT conv_id FROM own)),
        r AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS d, md5(t) AS t, w FROM (
                SELECT c.conv_id, 0 AS own, p, t, w FROM c JOIN own o ON o.conv_id = c.base AND o.p <= c.h
                UNION ALL SELECT c.conv_id, 1, p, t, w FROM c JOIN own o ON o.conv_id = c.conv_id AND o.p > c.h)),
        path AS (
            SELECT conv_id, d, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY d) AS path, w, d = max(d) OVER (PARTITION BY conv_id) AS last FROM r
            UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM r) FROM c),
        node AS (
            SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS tokens,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM path GROUP BY path),
        kid AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM node WHERE path <> '' GROUP BY 1),
        full_node AS (SELECT node.*, coalesce(kid.n, 0) AS n_children FROM node LEFT JOIN kid USING (path)),
        tree AS (
            SELECT left(path, 32 * k) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(tokens) AS saved_tokens
            FROM (SELECT path, n_children, tokens, unnest(range(length(path) // 32 + 1)) AS k FROM full_node) GROUP BY 1)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM full_node n JOIN tree t USING (path) LEFT JOIN node p ON n.path <> '' AND p.path = left(n.path, length(n.path) - 32)""",
    "op7_kd_tree_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10""",
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op6_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams FROM w),
        g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p WHERE 100 * shared >= 80 * (nx + ny - shared)),
        r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
        SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON s.doc_id = m.x""",
}
