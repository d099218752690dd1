"""The registered queries of the operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurespark.llm import (
    alignment,
    chat,
    exact,
    language,
    lexicon,
    licences,
    near,
    packing,
    partitions,
    quality,
    repair,
    toxicity,
    trie,
)
from featurespark.llm.common import held_out, read_table, work_path, work_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_sum_of_squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, folder, "documents"), TOKENIZER)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_repair_tokens(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "tokens")
    repair.write_tokens(read_table(spark, folder, "documents"), TOKENIZER, path)
    return repair.read_tokens(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op3_weak_supervision_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents, out = read_table(spark, folder, "documents"), held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(documents, read_table(spark, folder, "labels"), ~out)
    return toxicity.score(documents, model).withColumn("held_out", out)


def op4_bloom_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact.exact_groups(read_table(spark, folder, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    return partitions.nearest(read_table(spark, folder, "embeddings"))


def op6_offset_aligned_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    formatted = work_table(chat.format_conversations(turns.unionByName(planted), TOKENIZER), "chat")
    return chat.digest_conversations(formatted)


def op7_dice_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan_licences(read_table(spark, folder, "documents"))


def op8_transducer_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    encoded = lexicon.encode(read_table(spark, folder, "documents"), TOKENIZER, decoded=True, listed=True)
    digests = (F.sha2(c, 256).alias(n) for c, n in (("listed", "ids_sha256"), ("text", "decoded_sha256")))
    return encoded.select("doc_id", "n_tokens", *digests)


def op9_byte_gru_language(spark: SparkSession, folder: str) -> DataFrame:
    documents, out = read_table(spark, folder, "documents"), held_out(F.col("doc_id"), 3, 1)
    languages, weights = language.fit(documents.filter(~out))
    return language.predict(documents, languages, weights).withColumn("held_out", out)


def op10_tensored_minhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = near.near_groups(read_table(spark, folder, "documents"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return groups.select("doc_id", "n_shingles", "component_id", kept)


def op11_burst_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt_conversations(read_table(spark, folder, "conversations")))


def op12_boosted_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    return quality.judge(documents, quality.fit(documents, read_table(spark, folder, "labels")))


def op13_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_tokens(read_table(spark, folder, "documents"), TOKENIZER, PIECES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sum_of_squares_packing,
        op2_repair_tokens,
        op3_weak_supervision_toxicity,
        op4_bloom_exact_dedup,
        op5_learned_partitions,
        op6_offset_aligned_chat,
        op7_dice_licences,
        op8_transducer_lexicon,
        op9_byte_gru_language,
        op10_tensored_minhash,
        op11_burst_prefix_trie,
        op12_boosted_quality_rules,
        op13_cross_tokenizer_alignment,
    )
}

ORACLES: dict[str, str] = {
    "op7_dice_licences": licences.licence_sql(),
    "op4_bloom_exact_dedup": r"""
        WITH normal AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM normal WINDOW same AS (PARTITION BY t)
    """,
    "op11_burst_prefix_trie": r"""
        WITH turns AS (
            SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ),
        borrowed AS (
            SELECT conv_id, own, xor(4294967295, list_reduce(
                list_concat([4294967295::BIGINT], range(9 * len(conv_id::VARCHAR))),
                lambda crc, i: CASE
                    WHEN i % 9 = 0 THEN xor(crc, ord(substr(conv_id::VARCHAR, (i // 9 + 1)::INT, 1))::BIGINT)
                    ELSE xor(crc >> 1, (crc & 1) * 3988292384) END)) % 6 AS h
            FROM turns
        ),
        built AS (
            SELECT b.conv_id, list_concat(coalesce(f.own[1 : b.h], []), b.own[b.h + 1 :]) AS s
            FROM borrowed b LEFT JOIN turns f ON f.conv_id = b.conv_id - b.conv_id % 100
        ),
        prefixes AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM built),
        node AS (
            SELECT s[1 : d] AS p, d, min(conv_id) AS conv_id, count(*) AS n,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends
            FROM prefixes GROUP BY s[1 : d], d
        ),
        family AS (
            SELECT c.p, c.d, c.conv_id, c.n, c.ends, u.conv_id AS parent
            FROM node c LEFT JOIN node u ON u.d = c.d - 1 AND u.p = c.p[1 : c.d - 1]
        ),
        children AS (SELECT p[1 : d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
        weighed AS (
            SELECT f.*, coalesce(k, 0) AS k, CASE WHEN f.d = 0 THEN 0 ELSE (n - 1) * length(f.p[f.d].t) END AS own
            FROM family f LEFT JOIN children c ON c.p = f.p
        ),
        up AS (SELECT p[1 : a] AS p, k, own FROM (SELECT *, unnest(range(d + 1)) AS a FROM weighed)),
        sums AS (SELECT p, count(*) FILTER (k = 0) AS n_leaves, sum(own) AS saved FROM up GROUP BY p)
        SELECT conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, k AS n_children, n_leaves,
               saved::BIGINT AS saved_tokens, ends AS ends_sha256
        FROM weighed JOIN sums USING (p)
    """,
    "op10_tensored_minhash": r"""
        WITH RECURSIVE cut AS (
            SELECT doc_id, list_filter(
                string_split_regex(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[\x20\x09-\x0D]+'),
                lambda x: x <> '') AS w
            FROM documents
        ),
        sets AS (
            SELECT doc_id, CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE list_distinct(
                list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
            FROM cut
        ),
        shingle AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
        pair AS (
            SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
            FROM shingle a JOIN shingle b
              ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ),
        edge AS (SELECT u, v FROM pair UNION SELECT v, u FROM pair),
        reach AS (
            SELECT doc_id, doc_id AS r FROM documents
            UNION
            SELECT reach.doc_id, edge.v FROM reach JOIN edge ON edge.u = reach.r
        )
        SELECT sets.doc_id, len(s) AS n_shingles, min(r) AS component_id, sets.doc_id = min(r) AS kept
        FROM sets JOIN reach USING (doc_id) GROUP BY sets.doc_id, len(s)
    """,
}
