"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    backoff_lm,
    best_fit_packing,
    conversation_repair,
    embedding_dedup,
    exact_dedup,
    fill_in_middle,
    hilbert_sharding,
    language_id,
    mixing,
    order_minhash,
    packing,
    secret_scan,
    url_filter,
)

#: The tokenizers of the packing queries; a parameter of the operators.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """The class of near copies that each document is in."""
    classes = order_minhash.near_duplicate_classes(table(spark, folder, "documents"))
    return classes.select(
        F.col("id").alias("doc_id"), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def op2_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in one of 24 shards of equal row counts along a Hilbert curve."""
    rows = hilbert_sharding.assign_shards(table(spark, folder, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("curve").alias("curve_index"),
    )


def op3_water_filling_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How many words the mix takes from each document."""
    plan = mixing.mix_plan(table(spark, folder, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    found = secret_scan.find_secrets(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(k) for k in secret_scan.BASE_KINDS],
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op5_backoff_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The language model score of every document under the counts of all."""
    scored = backoff_lm.score_documents(table(spark, folder, "documents"))
    return scored.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.round("log_score", 4).alias("log_score"),
        F.round(F.col("log_score") / F.col("n_words"), 4).alias("mean_log_score"),
    )


def op6_curve_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as pieces of sequences of 4096 tokens."""
    pieces = packing.pack(table(spark, folder, "documents"), TOKENIZER)
    return pieces.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op7_pigeonhole_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near copies among the embeddings of each label."""
    found = embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    found = language_id.identify(table(spark, folder, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page's URL."""
    judged = url_filter.judge_urls(table(spark, folder, "pages"))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Exact copies but for the case of A to Z; the largest doc_id stays."""
    groups = exact_dedup.exact_groups(
        table(spark, folder, "documents"), keep="largest", normalise=exact_dedup.ascii_lower
    )
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op11_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as pieces of as few sequences of at most 2048 tokens as the method finds."""
    pieces = best_fit_packing.pack(table(spark, folder, "documents"), BYTE_TOKENIZER)
    return pieces.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document transformed and restored, as digests."""
    moved = fill_in_middle.fill_in_middle(table(spark, folder, "documents"))
    return moved.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored("output", "form"), 256).alias("restored_sha256"),
    )


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every damaged conversation with its faults and the cheapest repair."""
    damaged = conversation_repair.damage(table(spark, folder, "conversations"))
    return conversation_repair.repair_conversations(damaged, present_col="present")


QUERIES = {
    "op1_order_minhash": op1_order_minhash,
    "op2_hilbert_shards": op2_hilbert_shards,
    "op3_water_filling_mix": op3_water_filling_mix,
    "op4_secret_scan": op4_secret_scan,
    "op5_backoff_scores": op5_backoff_scores,
    "op6_curve_packing": op6_curve_packing,
    "op7_pigeonhole_join": op7_pigeonhole_join,
    "op8_language_id": op8_language_id,
    "op9_url_filter": op9_url_filter,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {
    "op5_backoff_scores": r"""
        WITH t AS (
            SELECT doc_id, ['<s>'] || list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') || ['</s>'] AS words
            FROM documents),
        bigrams AS (
            SELECT doc_id, words[i] AS v, words[i + 1] AS w
            FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM t)),
        pairs AS (SELECT v, w, count(*) AS n FROM bigrams GROUP BY v, w),
        firsts AS (SELECT v, count(*) AS n FROM bigrams GROUP BY v),
        lasts AS (SELECT w, count(*) AS n FROM bigrams GROUP BY w),
        total AS (SELECT count(*) AS n FROM bigrams),
        scored AS (
            SELECT b.doc_id, CASE WHEN p.n >= 2 THEN ln(p.n / f.n) ELSE ln(0.4 * l.n / total.n) END AS s
            FROM bigrams b JOIN pairs p USING (v, w) JOIN firsts f USING (v) JOIN lasts l USING (w) CROSS JOIN total)
        SELECT doc_id, count(*) AS n_words, round(sum(s), 4) AS log_score, round(sum(s) / count(*), 4) AS mean_log_score
        FROM scored GROUP BY doc_id
    """,
    "op9_url_filter": r"""
        WITH u AS (
            SELECT page_id, CASE WHEN coalesce(instr(url, '://'), 0) > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        p AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM u),
        rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
            ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        fits AS (
            SELECT page_id, max_by(r.h || r.p, length(r.h || r.p)) AS rule, max_by(r.verdict, length(r.h || r.p)) AS verdict
            FROM p JOIN rules r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
            GROUP BY page_id)
        SELECT p.page_id, p.host, p.path, f.rule,
               CASE WHEN f.rule IS NOT NULL THEN f.verdict
                    WHEN contains(p.host, 'casino') OR contains(p.host, 'free-bets')
                      OR contains(p.host, 'cheap-pills') OR contains(p.host, 'ads-track') THEN 'block'
                    ELSE 'allow' END AS verdict
        FROM p LEFT JOIN fits f USING (page_id)
    """,
    "op10_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op12_fill_in_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h
            FROM documents),
        c AS (
            SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
                   CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                             OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                        WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM d),
        p AS (
            SELECT *, '<P>' || substr(t, 1, least(a, b)) AS prefix, '<M>' || substr(t, least(a, b) + 1, abs(a - b)) AS middle,
                   '<S>' || substr(t, greatest(a, b) + 1) AS suffix
            FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN abs(a - b) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN prefix || suffix || middle
                                ELSE suffix || prefix || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
    """,
}
