"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a DataFrame, which
is written as Parquet to the shared folder and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``; ``n_chars`` follows the text where a stage cuts it.

Rows without text fail the quality rules. Rows without an id take part like all others; the near-duplicate stage
keeps them, as they belong to no group. An empty table passes through every stage.

Stages set the session to ``HELD_AT_ONCE``: tasks read and hand over whole texts in batches of bounded size.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apilens.llm import exact_dedup, mixing, packing, repetition, simhash, tokens
from apilens.llm.common import new_path, table
from apilens.shipping import ship

#: Fewer than for packing alone: workers still hold memory of the stages before.
REMEMBERED_WORDS = 200_000
#: By default a task holds 4,096 texts from files, on the heap, and 10,000 or 64 MB of them beside it and in Python.
HELD_AT_ONCE = {
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def _stage(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in HELD_AT_ONCE.items():
            docs.sparkSession.conf.set(name, value)
        return stage(spark, docs, sf_dir)

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the repetition rules keep."""
    return repetition.keep_good(docs)


@_stage
def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (white space aside): the longest, then the smallest id."""
    index = exact_dedup.DigestIndex(spark, f"corpus_digests_{uuid.uuid4().hex}")
    return exact_dedup.drop_duplicates(docs, index)


@_stage
def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group: near SimHash fingerprints (three-word shingles, three bits) and
    similar sets of shingles (five words, 0.8) both link."""
    return simhash.drop_similar(docs)


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights, by whole documents, some repeated; at most two a source are cut."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@_stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokens.vocabulary_path(), remembered=REMEMBERED_WORDS, forget=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_deduplication", exact_deduplication),
    ("near_deduplication", near_deduplication),
    ("source_mixing", source_mixing),
    ("packed_sequences", packed_sequences),
]

#: SQL has no tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
