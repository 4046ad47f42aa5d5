"""The queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.llm import bpe, html, language, mixing, mtree, near, ngram_lm, quality, randomness, repair, substring, trie, warc
from lociq.session import pick, table


def vocabulary() -> str:
    """Where the tokenizer file lies: LOCIQ_TOKENIZER, or the public one of this machine."""
    if path := os.environ.get("LOCIQ_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary())


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.captures(warc.write_archives(table(spark, sf_dir, "pages")))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"), size=20)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(pick(table(spark, sf_dir, "documents"), "doc_id", "source", "text").select("doc_id", "source", F.char_length("text").alias("n_text")), size=F.col("n_text")).drop("n_text")


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return randomness.find(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_html": op2_html,
    "op3_warc": op3_warc,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_quality_rules": op5_quality_rules,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_mixing": op8_mixing,
    "op9_class_lm": op9_class_lm,
    "op10_language_id": op10_language_id,
    "op11_secrets": op11_secrets,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_repair": op13_repair,
}

#: Base 32 as to_base writes it, and as digests are written.
_DIGITS = " || ".join(f"to_base(('0x' || substring(h, {5 * i + 1}, 5))::BIGINT, 32, 4)" for i in range(8))
WARC_ORACLE = rf"""
WITH d AS (SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d),
u AS (SELECT *, lower(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1), '^www\.', '')) AS host,
  regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS way, regexp_extract(url, '^[^#?]*([?][^#]+)', 1) AS asked FROM g)
SELECT page_id, payload_bytes, translate({_DIGITS}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to,
  array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || lower(CASE way WHEN '' THEN '/' ELSE way END || asked) AS url_key,
  strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM u"""

#: DuckDB twins; the other queries are tested against brute force in tests/llm.
ORACLES = {"op3_warc": WARC_ORACLE, "op5_quality_rules": quality.ORACLE, "op8_mixing": mixing.ORACLE, "op12_prefix_trie": trie.ORACLE.replace("CRC", repair.CRC32.format("conv_id::VARCHAR")), "op13_repair": repair.ORACLE}
