"""The queries opN_<name> over the input tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversations, decontaminate, html, langid, linededup, packing, periodic, quality, simhash, suffixes, toxicity, url_filter
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return made.select("page_id", "host", "path", "rule", "strict_hits", "soft_hits", "verdict")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many lines it has, how many go, and a digest of the text that stays (of no bytes for null)."""
    made = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(table(spark, sf_dir, "conversations"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_quality, op2_url_filter, op3_repeats, op4_language, op5_decontaminate, op6_toxicity, op7_nearest, op8_pack, op9_line_dedup, op10_simhash, op11_conversations, op12_periodic, op13_html)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": url_filter.oracle(), "op5_decontaminate": decontaminate.oracle(), "op11_conversations": conversations.oracle()}
