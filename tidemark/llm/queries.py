"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annforest, bpecodec, collocation, convtrie, exactdedup, langid, license, linededup, mincut, packing, repetition, setjoin, tokencount
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annforest.nearest(table(spark, sf_dir, "embeddings"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op6_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.extract(table(spark, sf_dir, "pages"))


def op7_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op9_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_components(table(spark, sf_dir, "documents"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpecodec.digests(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
    return repetition.quality(table(spark, sf_dir, "documents")).select(*counts, "base_failed", "kept")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_exact_dedup, op4_hash_forest, op5_license_scan, op6_html_mincut, op7_lp_packing, op8_token_counts, op9_jaccard_groups, op10_bpe_codec, op11_quality_rules, op12_collocations, op13_conversation_trie)}
ORACLE_SQL = {"op2_line_dedup": linededup.SQL, "op3_exact_dedup": exactdedup.SQL, "op5_license_scan": license.SQL, "op9_jaccard_groups": setjoin.SQL, "op11_quality_rules": repetition.SQL, "op12_collocations": collocation.SQL, "op13_conversation_trie": convtrie.SQL}
