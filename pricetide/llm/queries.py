"""The corpus operators as queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import (
    bpe, conversations, exact_dedup, html_text, packing, quality_net, quality_rules, sharding, shingle_join, token_files, topk,
    toxicity, whitening,
)
from pricetide.llm.common import documents, materialize
from pricetide.session import passing, shared_folder


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "group_size")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), *codec).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _scored(docs: DataFrame, model, parts: int, part: int) -> DataFrame:
    return toxicity.with_score(docs, model, keep=["doc_id"]).select(
        "doc_id", toxicity.held_out("doc_id", parts, part).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _scored(docs, toxicity.train(docs, _labels(spark, sf_dir)), 5, 0)


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat token files that Spark makes from all documents, then counted from the files alone.

    The long documents' files come first, so that their chunks are gone when the others are written. Ids up to the
    separator fit into two bytes.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    end_of_document, width, folder, manifest = 50256, 2, shared_folder(spark), f"{shared_folder(spark)}/manifest"
    write = (lambda branch: token_files.file_writer(folder, end_of_document, width, branch=branch, branches=2),
             token_files.manifest_schema(docs.schema["doc_id"].dataType.simpleString()))
    for which in "long", "short":
        with passing(spark):
            bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, then=write,
                       which=(which,)).write.mode("append").parquet(manifest)
    manifest = spark.read.parquet(manifest)
    files = manifest.groupBy("file").agg(F.sum("size").alias("length"))
    return token_files.named(token_files.count_files(files, end_of_document, width), manifest)


def op9_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _scored(docs, quality_net.train(docs, _labels(spark, sf_dir)), 3, 1)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(quality_rules.with_statistics(documents(spark, sf_dir), keep=["doc_id"]))
    rules = quality_rules.learn_rules(*quality_rules.labelled_sample(found, _labels(spark, sf_dir)))
    failed = quality_rules.base_failed()
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), (~failed & quality_rules.verdict(rules)).alias("kept"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0).select(
        F.col("query_id").cast("long"), "rank", F.col("vec_id").cast("long"), "score")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.digested(rows, conversations.plan(rows, "gone"), "gone")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select(
        "vec_id", "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened", "explained",
        "identity_error")


QUERIES = {q.__name__: q for q in (
    op1_sharding, op2_exact_dedup, op3_bpe, op4_packing, op5_html_text, op6_toxicity, op7_shingle_join,
    op8_token_counts, op9_quality_net, op10_quality_rules,
    op11_topk, op12_conversations, op13_whitening)}

ORACLE = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_topk": """
        WITH whole AS (
            SELECT vec_id, row_number() OVER () AS r,
                   list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, q.r AS asked, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.r <> c.r WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    # A path per state after every row: the least (cost, edits), with the turns that it leaves.
    "op12_conversations": r"""
        WITH RECURSIVE marked AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(list_prepend(4294967295, list_transform(string_split(
                           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                       lambda crc, byte: xor(crc >> 8, list_reduce([xor(crc, byte) & 255, 0, 0, 0, 0, 0, 0, 0, 0],
                           lambda c, i: xor(c >> 1, 3988292384 * (c & 1))))), 4294967295) % 20 AS kind
            FROM conversations
        ), damaged AS (
            SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM marked WHERE kind <> 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
                   right(rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 1) AS last FROM damaged
        ), faults AS (
            SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, last = '' AS blank, last <> '' AND nth > 1 AS duplicate,
                   last <> '' AND nth = 1 AND last NOT IN ('.', '!', '?') AS truncated,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
            FROM placed
        ), report AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                   count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM faults GROUP BY conv_id
        ), moves(before, edit, initial, after, base) AS (
            SELECT * FROM (VALUES ('', 'D', NULL, '', 3), ('s', 'D', NULL, 's', 3), ('u', 'D', NULL, 'u', 3), ('a', 'D', NULL, 'a', 3),
                ('', 'K', 's', 's', 0), ('', 'K', 'u', 'u', 0), ('s', 'K', 'u', 'u', 0), ('a', 'K', 'u', 'u', 0), ('u', 'K', 'a', 'a', 0),
                ('', 'R', NULL, 'u', 2), ('s', 'R', NULL, 'u', 2), ('a', 'R', NULL, 'u', 2), ('u', 'R', NULL, 'a', 2)) v
        ), added(before, edits, after, base) AS (
            SELECT * FROM (VALUES ('', '', '', 0), ('s', '', 's', 0), ('u', '', 'u', 0), ('a', '', 'a', 0),
                ('', 'I', 'u', 2), ('s', 'I', 'u', 2), ('a', 'I', 'u', 2), ('u', 'I', 'a', 2),
                ('', 'II', 'a', 4), ('s', 'II', 'a', 4)) v
        ), paths AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit,
                   CAST([] AS STRUCT(role VARCHAR, text VARCHAR)[]) AS turns FROM report
            UNION ALL
            SELECT conv_id, i, state, least_.cost, least_.audit, least_.turns FROM (
                SELECT p.conv_id, r.i, m.after AS state, min({'cost': p.cost + a.base + m.base + CASE WHEN r.truncated AND m.edit <> 'D' THEN 1 ELSE 0 END,
                           'audit': p.audit || a.edits || m.edit,
                           'turns': list_concat(p.turns,
                               list_transform(string_split(a.edits, ''), lambda c, k: {'role': CASE WHEN p.state = 'u' AND k % 2 = 1 OR p.state <> 'u' AND k % 2 = 0 THEN 'assistant' ELSE 'user' END, 'text': ''})[:length(a.edits)],
                               CASE m.edit WHEN 'D' THEN [] WHEN 'K' THEN [{'role': r.role, 'text': r.text}]
                                   ELSE [{'role': CASE m.after WHEN 'u' THEN 'user' ELSE 'assistant' END, 'text': r.text}] END)}) AS least_
                FROM paths p JOIN faults r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
                JOIN added a ON a.before = p.state JOIN moves m ON m.before = a.after
                WHERE (m.initial IS NULL OR m.initial = r.initial) AND (m.edit = 'D' OR NOT (r.blank OR r.duplicate))
                GROUP BY p.conv_id, r.i, m.after)
        ), ends AS (
            SELECT p.conv_id, min({'cost': p.cost + a.base, 'audit': p.audit || a.edits, 'turns': list_concat(p.turns,
                       list_transform(string_split(a.edits, ''), lambda c, k: {'role': CASE WHEN p.state = 'u' AND k % 2 = 1 OR p.state <> 'u' AND k % 2 = 0 THEN 'assistant' ELSE 'user' END, 'text': ''})[:length(a.edits)])}) AS best
            FROM paths p JOIN report r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = p.i JOIN added a ON a.before = p.state
            WHERE a.after IN ('', 'a') GROUP BY p.conv_id
        )
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
               coalesce(best.audit, '') AS audit,
               sha256(coalesce(array_to_string(list_transform(best.turns, lambda t: t.role || ':' || t.text), chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN report r ON r.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
}
