"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest, one row per known text. A batch of documents is
reduced to one row per digest (map-side combined, so a group of copies of any size is one row per task),
the rows that the index lacks are found by a sort-merge anti-join, for which the index is neither shuffled
nor, as long as a bucket has one file, sorted, and are appended. Between batches the first one wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apilens.llm.common import BLANKS, stored

BUCKETS = 16


def digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text without its white space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, ""), 256)


class DigestIndex:
    """The index ``table``, created at ``path`` (or in the warehouse) if the session does not know it.

    A session that finds the files of an earlier one at ``path`` goes on with them. The number of buckets is
    fixed when the index is created. One writer at a time; a batch that is added again after a failure adds
    nothing twice.
    """

    def __init__(self, spark: SparkSession, table: str, path: str | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.table, self.buckets = spark, table, buckets
        self._path = path
        if not spark.catalog.tableExists(table):
            at = f"LOCATION '{path}'" if path else ""
            spark.sql(
                f"CREATE TABLE {table} (digest STRING, keep_id BIGINT, n_points BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS {at}"
            )

    def add(self, best: DataFrame) -> None:
        """Append the rows (digest, keep_id, n_points), one per digest, whose digest is new."""
        known = self.spark.table(self.table).select("digest")
        fresh = best.select("digest", "keep_id", "n_points").join(known.hint("merge"), "digest", "left_anti")
        writer = fresh.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        (writer.option("path", self._path) if self._path else writer).saveAsTable(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)


def decide(
    docs: DataFrame, index: DigestIndex, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Add the batch to the index; (doc_id, text_sha256, keep_id, group_size, kept) of every row of it.

    Of equal texts in a batch the one with the most code points stays, then the smallest id (rows without
    an id last, repeated rows: one of them); all rows give way to a text that the index had before.
    ``group_size`` counts the rows of the batch. An empty batch gives an empty result.
    """
    digests = stored(
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            digest(F.col(text_column)).alias("text_sha256"),
            F.coalesce(F.length(text_column), F.lit(0)).cast("long").alias("n_points"),
            F.monotonically_increasing_id().alias("row"),  # stable, as it is stored
        ),
        "digests",
    )
    # max_by takes the largest struct: longest text, then smallest id, rows without an id last
    rank = F.struct(
        F.col("n_points"), F.col("doc_id").isNotNull(), -F.coalesce("doc_id", F.lit(0)), -F.col("row")
    )
    best = stored(
        digests.groupBy(F.col("text_sha256").alias("digest"))
        .agg(
            F.max_by(F.struct("doc_id", "row", "n_points"), rank).alias("best"),
            F.count("*").alias("group_size"),
        )
        .select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.n_points").alias("n_points"),
                F.col("best.row").alias("best_row"), "group_size"),
        "best-of-digest",
    )
    before = index.rows().select("digest", F.col("keep_id").alias("earlier_id"), F.lit(True).alias("earlier"))
    # the earlier rows have to be read before the batch is added
    known = stored(best.join(before.hint("merge"), "digest", "left"), "known-digests")
    index.add(best)
    return digests.join(known, F.col("text_sha256") == F.col("digest")).select(
        "doc_id",
        F.when(F.col("earlier"), F.col("earlier_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        "group_size",
        (F.col("earlier").isNull() & (F.col("row") == F.col("best_row"))).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(
    docs: DataFrame, index: DigestIndex, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row, with all its columns, of each text that the index lacks; the rows that ``decide`` keeps."""
    decided = stored(decide(docs, index, id_column, text_column), "decided")
    kept = decided.filter("kept").select(
        F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_digest")
    )
    rows = docs.join(
        kept,
        (F.col(id_column).cast("long").eqNullSafe(F.col("_kept_id")))
        & (digest(F.col(text_column)) == F.col("_kept_digest")),
        "left_semi",
    )
    # rows that repeat the id and the text that stay (but for white space) all pass the semi-join
    repeated = decided.filter("doc_id <=> keep_id").groupBy("doc_id", "text_sha256").count().filter("count > 1")
    if repeated.isEmpty():
        return rows
    rank = F.struct(F.length(text_column), *(F.col(c) for c in docs.columns if not _is_map(docs, c)))
    return (
        rows.groupBy(F.col(id_column).alias("_i"), digest(F.col(text_column)).alias("_d"))
        .agg(F.max_by(F.struct(*(F.col(c) for c in docs.columns)), rank).alias("_row"))
        .select("_row.*")
    )


def _is_map(docs: DataFrame, column: str) -> bool:
    return docs.schema[column].dataType.typeName() == "map"
