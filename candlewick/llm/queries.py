"""The registered queries of this package and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_extract, jaccard_join, license_scan, packing, quality_rules, sharding, substring_dedup, url_filter
from .common import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE_SQL["op8_quality_rules"] = quality_rules.oracle("documents", "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept")


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


ORACLE_SQL["op9_decontaminate"] = decontaminate.oracle()


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.examples(chat_format.with_hostile(table(spark, sf_dir, "conversations"))))


ORACLE_SQL["op4_chat_format"] = chat_format.oracle()


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = f"{shared_dir(spark)}/candlewick-slots-{uuid.uuid4().hex}"
    return sharding.sharded(table(spark, sf_dir, "documents"), store).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))
    taken = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "text", F.size("__spans").cast("long").alias("n_repeats"), taken.alias("repeated_bytes"), F.col("__spans").alias("spans"))


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies", "is_first")


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    marks = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.judged(pages, pages.select("page_id", "url").join(marks, "page_id"))


ORACLE_SQL["op5_url_filter"] = url_filter.oracle()


@query
def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a tree of files: source/language/thousand/hundred. One that opens with a licence line is its thousand's licence file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    opens = F.coalesce(F.col("text").rlike(r"(?i)^[^\n]*\blicen[cs]ed?\b"), F.lit(False))
    top = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000))
    path = F.when(opens, F.concat(top, F.lit("/LICENSE-"), "doc_id")).otherwise(F.concat(top, F.lit("/"), F.floor(F.col("doc_id") / 100), F.lit("/"), "doc_id", F.lit(".txt")))
    return license_scan.scan(docs.select("doc_id", path.alias("path"), "text")).withColumn("similarity", F.round("similarity", 6))
