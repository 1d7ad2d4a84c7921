"""The registered queries of this subpackage: ``QUERIES`` and, where SQL can express them, ``SQL`` for DuckDB."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vellum.llm import bpe, decontaminate, dimscan, filteraudit, linededup, passages, perspectives, phrases, quality, sharding, simhash, tokenfile, urlfilter
from vellum.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def op1_url_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op3_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


def op5_arrow_token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.written_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_bpe_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_classes(table(spark, sf_dir, "documents"))


def op9_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash_anchor_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimscan.search_embeddings(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_url_boosted_trees": op1_url_boosted_trees,
    "op2_perspective_rotation": op2_perspective_rotation,
    "op3_quality_mcd": op3_quality_mcd,
    "op4_line_windows": op4_line_windows,
    "op5_arrow_token_stream": op5_arrow_token_stream,
    "op6_bpe_word_table": op6_bpe_word_table,
    "op7_ring_shards": op7_ring_shards,
    "op8_compact_windows": op8_compact_windows,
    "op9_latent_decontamination": op9_latent_decontamination,
    "op10_simhash_anchor_cover": op10_simhash_anchor_cover,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_dimension_scan": op12_dimension_scan,
    "op13_filter_audit": op13_filter_audit,
}

SQL: dict[str, str] = {
    "op2_perspective_rotation": perspectives.SQL,
    "op11_phrase_collocations": phrases.SQL,
    "op13_filter_audit": filteraudit.SQL,
    "op4_line_windows": linededup.SQL.format(docs="documents"),
}
