"""Incremental extract: every run takes what was added to the capture folder since the last one."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from apilens.operators.extract import drop_health_checks, project_extract
from apilens.sources.captures import COMPRESSION, parse_capture_lines


def extract_new(
    spark: SparkSession,
    captures: str,
    output: str,
    checkpoint: str,
    skip_health_checks: bool = True,
    max_files_per_trigger: int = 256,
) -> StreamingQuery:
    """Project new capture records to JSON Lines under ``output``; the checkpoint is the position."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(captures)
    records = parse_capture_lines(lines)
    kept = drop_health_checks(records) if skip_health_checks else records
    return (
        project_extract(kept)
        .writeStream.format("json")
        .option("path", output)
        .option("compression", COMPRESSION)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
