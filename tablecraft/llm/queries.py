"""The numbered operators, each over its whole table, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.llm import (
    hard_negatives,
    imatch,
    language_id,
    line_dedup,
    lm_scoring,
    mixing,
    packing,
    prefix_trie,
    quality_model,
    quality_rules,
    simhash,
    suffix_dedup,
    url_filter,
)
from tablecraft.llm.shipping import ship_package
from tablecraft.llm.text import table
from tablecraft.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "word_bpe_49k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return cleaned.select(
        "doc_id",
        F.col("__lines").alias("n_lines"),
        F.col("__dropped").alias("n_dropped"),
        digest.alias("text_md5"),
    )


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces with a checksum of their ids, and their places."""
    pieces = packing.tokenize(docs, public_tokenizers.path(VOCABULARY))
    stored = materialize(
        pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "packing-pieces"
    )
    return packing.pack(stored)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
               "base_failed", "kept")
    return judged.select("doc_id", *(F.col(f"__{name}").alias(name) for name in figures))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies", "source")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle_words=3, radius=2)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform(
        "embedding",
        lambda x: F.when(F.abs(x) < float("inf"), F.floor(x.cast("double") * 256)),
    )
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", moved.alias("label"), whole.alias("vector")
    )
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_nodes(prefix_trie.with_shared_heads(turns))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.removals(docs).drop("text")


_REGISTERED = (
    op1_language_id,
    op2_line_dedup,
    op3_document_fingerprints,
    op4_best_fit_packing,
    op5_lm_scoring,
    op6_quality_classifier,
    op7_quality_rules,
    op8_url_filters,
    op9_mixing_sources,
    op10_simhash_near_dedup,
    op11_hard_negatives,
    op12_prefix_trie,
    op13_suffix_array_dedup,
)


def queries() -> dict[str, Query]:
    def shipped(query: Query) -> Query:
        return lambda spark, sf_dir: query(ship_package(spark), sf_dir)

    return {query.__name__: shipped(query) for query in _REGISTERED}
