"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, exact_dedup, jaccard, mixing, pii, quality, sharding, token_counts, toxicity


#: Text bytes of a shard in the registered query.
SHARD_LIMIT = 16 << 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a scan of fewer splits than the session has cores is dealt over the cores, a larger one is left as it is."""
    scan, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return scan.repartition(cores) if name == "documents" and scan.rdd.getNumPartitions() < cores else scan


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, rare sources up to twice."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs, max_repeats=2.0).drop("text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flagged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.format_chats(conversations, "byte_bpe_50k.json", with_tokens=False)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of a small limit, so that prefixes are split at every scale; the pipeline takes the default."""
    return sharding.shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_LIMIT).drop("text")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_toxicity, op3_token_counts, op4_quality, op5_decontamination, op6_chat_format, op7_sharding, op8_jaccard_join, op9_pii, op10_exact_dedup)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
_ESCAPES = r"len(regexp_extract_all({}, '<\\*(?:s>|/s>|\|endoftext\|>)|\[\\*(?:INST\]|/INST\])'))"

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": f"""
        WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        g AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
              FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        v AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
        h AS (SELECT doc_id, i, v.n, item FROM v JOIN g ON v.gram = g.gram AND v.n = g.n),
        p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
        q AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)""",
    "op6_chat_format": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
            SELECT conv_id, turn, role, text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(3 + sum(17 + length(role) + {_ESCAPES.format("role")} + length(text) + {_ESCAPES.format("text")}) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op7_sharding": f"""
        WITH d AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0)) || chr(31) || coalesce(md5(text), chr(0))), 1, 15)) AS BIGINT) AS h,
                   CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents),
        s AS (SELECT depth, h >> ({sharding.BITS} - depth) AS prefix, sum(bytes) AS bytes, count(*) AS n, sum(bytes) <= {SHARD_LIMIT} OR min(h) = max(h) AS fits
              FROM d, (SELECT unnest(range(0, {sharding.BITS} + 1)) AS depth) GROUP BY ALL),
        f AS (SELECT c.* FROM s c LEFT JOIN s p ON p.depth = c.depth - 1 AND p.prefix = c.prefix >> 1 WHERE c.fits AND (c.depth = 0 OR NOT p.fits))
        SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS INTEGER) AS shard_depth, CAST(f.bytes AS BIGINT) AS shard_bytes, CAST(n AS BIGINT) AS shard_rows
        FROM d JOIN f ON f.prefix = d.h >> ({sharding.BITS} - f.depth)""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
}
