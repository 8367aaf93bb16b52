"""The queries of the operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazardflow.llm import (
    binary_records,
    bpe,
    chat_rotation,
    cross_tokens,
    host_rules,
    html_wrappers,
    license_scan,
    near_dup,
    packing,
    pivot_search,
    prefix_trie,
    quality_classifier,
    token_counts,
)
from hazardflow.llm.storage import table
from hazardflow.session import shared_dir


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return chat_rotation.rotated(table(spark, sf_dir, "conversations")).withColumn("mask", F.array_join(spans, ","))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op5_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = binary_records.new_folder(spark)
    index = binary_records.write_records(table(spark, sf_dir, "documents"), folder)
    read = binary_records.token_starts(index, binary_records.read_records(spark, folder))
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {c: F.array_join(c, " ") for c in ("sentence_ids", "licenses", "unmatched")}
    return license_scan.scanned(table(spark, sf_dir, "documents")).withColumns(lists)


def op9_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(table(spark, sf_dir, "pages"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return host_rules.judged(table(spark, sf_dir, "documents")).select("doc_id", *measures, "base_failed", "kept")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from a cache that begins empty, so that every distinct text is encoded in this run."""
    return token_counts.counted(table(spark, sf_dir, "documents"), shared_dir(spark, "token-counts"))


def op13_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokens.cross_aligned(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_pivot_search": op2_pivot_search,
    "op3_chat_rotation": op3_chat_rotation,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_binary_records": op5_binary_records,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_license_scan": op8_license_scan,
    "op9_html_wrappers": op9_html_wrappers,
    "op10_host_rules": op10_host_rules,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_counts": op12_token_counts,
    "op13_cross_tokens": op13_cross_tokens,
}

ORACLES: dict[str, str] = {
    "op2_pivot_search": pivot_search.ORACLE,
    "op3_chat_rotation": chat_rotation.ORACLE,
    "op10_host_rules": host_rules.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
}
