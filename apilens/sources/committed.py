"""Capture folders with a manifest: records of a batch count from the moment its manifest is written, once.

``<path>/data/<writer>/batch=<n>-<attempt>`` holds what one attempt wrote, ``<path>/manifest/<writer>/batch=<n>`` one row that names
the attempt that counts and how many records it has. An attempt that was lost before its manifest is a folder that nobody
reads; a batch that comes again after its manifest writes nothing. Readers follow manifests, so neither file times nor late
files move a record, and the extract position is the last batch of every writer.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apilens.sources.captures import COMPRESSION, parse_capture_lines, to_capture_records

_MANIFEST = "writer string, batch bigint, folder string, records bigint"
_POSITION = "writer string, batch bigint"


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON rows; empty where there is none yet."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(writer, batch, folder, records) of all committed batches: a row per batch, not per record."""
    return _rows(spark, f"{path}/manifest", _MANIFEST)


def commit_captures(messages: DataFrame, path: str, batch: int, writer: str = "capture") -> bool:
    """Write the records of a batch and commit them; false if the batch was committed before.

    A writer numbers its batches upwards and is one process at a time, as the batches of a stream are.
    """
    spark = messages.sparkSession
    own = f"{path}/manifest/{writer}/batch={batch}"
    if not _rows(spark, own, _MANIFEST).isEmpty():
        return False
    folder = f"data/{writer}/batch={batch}-{uuid.uuid4().hex}"
    to_capture_records(messages).write.json(f"{path}/{folder}", compression=COMPRESSION)
    count = spark.read.text(f"{path}/{folder}").count()
    row = spark.range(1).select(
        F.lit(writer).alias("writer"),
        F.lit(batch).cast("bigint").alias("batch"),
        F.lit(folder).alias("folder"),
        F.lit(count).cast("bigint").alias("records"),
    )
    row.coalesce(1).write.mode("overwrite").json(own)
    return True


def _behind(spark: SparkSession, path: str, position: str | None) -> list[tuple[str, int, str, int]]:
    """Committed batches behind a position, one short row per batch."""
    batches = manifest(spark, path)
    if position is not None:
        last = read_position(spark, position).withColumnRenamed("batch", "last")
        batches = batches.join(last, "writer", "left").filter("last IS NULL OR batch > last")
    return [tuple(r) for r in batches.select("writer", "batch", "folder", "records").collect()]


def _records(spark: SparkSession, path: str, batches: list[tuple[str, int, str, int]]) -> DataFrame:
    folders = [f"{path}/{folder}" for _, _, folder, records in batches if records]
    return parse_capture_lines(spark.read.text(folders) if folders else spark.createDataFrame([], "value string"))


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """Records of all committed batches."""
    return _records(spark, path, _behind(spark, path, None))


def read_position(spark: SparkSession, path: str) -> DataFrame:
    """(writer, batch) up to which an extract has come; a new extract has come nowhere."""
    return _rows(spark, path, _POSITION).groupBy("writer").agg(F.max("batch").alias("batch"))


def read_new(spark: SparkSession, path: str, position: str) -> tuple[DataFrame, DataFrame]:
    """(records committed behind the stored position, the position behind them).

    Both are of the same moment: batches that are committed meanwhile belong to the next extract.
    """
    batches = _behind(spark, path, position)
    reached = spark.createDataFrame([b[:2] for b in batches], _POSITION)
    return _records(spark, path, batches), reached.groupBy("writer").agg(F.max("batch").alias("batch"))


def write_position(reached: DataFrame, path: str) -> None:
    """Commit an extract: positions only move on, so writing one again changes nothing."""
    reached.coalesce(1).write.mode("append").json(path)
