"""The queries of this subpackage: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apilens.llm import (
    collocations,
    exact_dedup,
    extraction,
    language,
    mixing,
    packing,
    repetition,
    resampling,
    sharding,
    simhash,
    token_files,
    tokens,
    toxicity,
    warc,
)
from apilens.llm.common import fold_of, new_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.vocabulary_path())


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_token_files(
        table(spark, sf_dir, "documents"),
        path,
        tokens.vocabulary_path(),
        vocabulary_size=49_408,
        end_id=2,
    )
    return token_files.read_token_files(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    model = language.fit(docs.filter(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.quality(table(spark, sf_dir, "documents"))
    return judged.drop("covered_words", "longest_repeat")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    weights = toxicity.fit(table(spark, sf_dir, "labels").filter(~held_out), docs)
    return toxicity.score(docs, weights).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    return exact_dedup.decide(table(spark, sf_dir, "documents"), index)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).drop("range")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_best_fit_packing,
            op2_token_files,
            op3_language_id,
            op4_simhash_near_dedup,
            op5_repetition_rules,
            op6_toxicity,
            op7_exact_dedup,
            op8_warc,
            op9_source_mixing,
            op10_html_extraction,
            op11_sharding,
            op12_collocations,
            op13_importance_resampling,
        )
    }
