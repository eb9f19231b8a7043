"""opN_<name> queries over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.llm import sql
from carelens.llm.bag_minhash import near_duplicates
from carelens.llm.cover_dedup import cover_dedup
from carelens.llm.crf_lang import crf_language
from carelens.llm.decontaminate import contained_items
from carelens.llm.fuzzy_lines import dedup_lines
from carelens.llm.line_rules import line_rules
from carelens.llm.merkle import merkle_manifest
from carelens.llm.mix_sources import mix_sources
from carelens.llm.sparse_suffixes import repeated_passages
from carelens.llm.suffix_tree_lm import suffix_tree_lm
from carelens.llm.warc import warc_index
from carelens.llm.whitening import whiten
from carelens.llm.zstd_toxicity import zstd_toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under the suffix tree and the base formula."""
    return suffix_tree_lm(documents(spark, sf_dir))


def op6_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds too."""
    return repeated_passages(documents(spark, sf_dir))


def op7_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removing repeated 50-word windows, per document."""
    return cover_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: Target weights of the mix by level; sources weigh the same.
MIX_WEIGHTS = {"domain": {"d0": 400, "d1": 300, "d2": 200, "d3": 100},
               "lang": {"en": 500, "de": 200, "fr": 200, "es": 100}}


def domain() -> Column:
    """The test data names no domains: sources fall into four by their number."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int")
    return F.concat(F.lit("d"), (number % 4).cast("string"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates(documents(spark, sf_dir))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and removed lines of every document."""
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens of the mix, per epoch."""
    return mix_sources(documents(spark, sf_dir), domain(), MIX_WEIGHTS).drop("th")


def op3_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from per-word CRF posteriors."""
    return crf_language(documents(spark, sf_dir))


def op9_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by compression distance."""
    return zstd_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first quality verdict of every document."""
    return line_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_lines_removed", "n_words_removed")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings on the first 16 whitened components."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))  # null beyond a long


def op12_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' captures in the merged index of their archives."""
    return warc_index(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "stamp", "rank", "valid")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, and the roots of the versions with a tampered one."""
    return merkle_manifest(documents(spark, sf_dir))


QUERIES = [op1_suffix_tree_lm, op2_decontaminate, op3_crf_language, op4_bag_minhash, op5_fuzzy_lines,
           op6_sparse_suffixes, op7_cover_dedup, op8_mix_sources, op9_zstd_toxicity, op10_line_rules,
           op11_whitening, op12_warc_index, op13_merkle_manifest]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op8_mix_sources": sql.MIX_SOURCES, "op10_line_rules": sql.LINE_RULES, "op12_warc_index": sql.WARC_INDEX,
            "op13_merkle_manifest": sql.MERKLE_MANIFEST}
