"""Capture files and logs: JSON Lines records, prefixed log lines, extract reports, positions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from apilens import schemas
from apilens.functions.values import iso_utc
from apilens.staging import staged

# Fixed value: prefix of capture records in a log.
LOG_PREFIX = "ENDPOINT_CAPTURE: "
#: How capture files and extracts are compressed. Readers tell by the name of a file, so plain ones are read as well.
COMPRESSION = "gzip"
_BROKEN = "_broken_line"


def _record_columns() -> list[Column]:
    """Canonical columns from a parsed record."""
    return [
        F.col("timestamp").try_cast("timestamp").alias("ts")
        if name == "ts"
        else F.col(name)
        for name in (part.split()[0] for part in schemas.HTTP_MESSAGES.split(", "))
    ]


def parse_capture_lines(lines: DataFrame) -> DataFrame:
    """Text lines (``value``) to records; blank lines and lines that do not parse are skipped.

    Every field of a record may be missing. Other columns of ``lines`` stay.
    """
    record = F.from_json(
        F.trim("value"),
        f"{schemas.CAPTURE_RECORD}, {_BROKEN} string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN},
    )
    given = [c for c in lines.columns if c != "value"]
    return (
        lines.filter(F.trim("value").startswith("{"))
        .select(record.alias("r"), *given)
        .filter(F.col(f"r.{_BROKEN}").isNull())
        .select("r.*", *given)
        .select(*_record_columns(), *given)
    )


def read_captures(spark: SparkSession, *paths: str) -> DataFrame:
    """Capture files of any number of nodes."""
    return parse_capture_lines(spark.read.text(list(paths)))


def read_positioned_captures(spark: SparkSession, *paths: str) -> DataFrame:
    """Capture files with the ``position`` (from 1) of every record among all lines.

    Files count by age, then name, so records keep their positions when files are added. Lines are numbered
    inside the pieces in which Spark reads files; only one row per piece meets in one place, and goes from there to
    the lines, which stay where they are.
    """
    lines = staged(
        spark.read.text(list(paths)).select(
            "value",
            F.col("_metadata.file_modification_time").alias("_age"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_line"),
        ),
        "capture-lines",
    )
    piece = ["_age", "_file", "_start"]
    sizes = lines.groupBy(*piece).agg(F.min("_line").alias("_first"), F.count("*").alias("_size"))
    before = W.orderBy(*piece).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *piece, (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    placed = lines.join(F.broadcast(offsets), piece).select(
        "value", (F.col("_line") + F.col("_shift") + 1).alias("position")
    )
    return parse_capture_lines(placed)


def read_capture_log(spark: SparkSession, *paths: str) -> DataFrame:
    """Records from log files, where other lines may stand between them."""
    lines = spark.read.text(list(paths)).filter(F.col("value").startswith(LOG_PREFIX))
    return parse_capture_lines(
        lines.select(F.substr(F.col("value"), F.lit(len(LOG_PREFIX) + 1)).alias("value"))
    )


def to_capture_records(messages: DataFrame) -> DataFrame:
    """Canonical records with the time as text, as they are stored in capture files."""
    return messages.select(
        *[
            iso_utc(F.col("ts")).alias("timestamp") if name == "ts" else F.col(name)
            for name in messages.columns
        ]
    )


def write_captures(messages: DataFrame, path: str, mode: str = "append") -> None:
    """JSON Lines; ``overwrite`` clears the file first, as at the start of a capture."""
    to_capture_records(messages).write.mode(mode).json(path, compression=COMPRESSION)


def to_log_lines(messages: DataFrame) -> DataFrame:
    records = to_capture_records(messages)
    return records.select(
        F.concat(F.lit(LOG_PREFIX), F.to_json(F.struct(*records.columns))).alias("value")
    )


def write_extract_report(projected: DataFrame, metadata: DataFrame, path: str) -> None:
    """Report as ``endpoints`` (JSON Lines, written in parallel) and one ``metadata`` document."""
    projected.write.mode("overwrite").json(f"{path}/endpoints")
    metadata.withColumn("extracted_at", iso_utc(F.current_timestamp())).coalesce(1).write.mode(
        "overwrite"
    ).json(f"{path}/metadata")


def read_position(spark: SparkSession, path: str) -> int:
    """Stored extract position; missing or unreadable gives 0."""
    try:
        table = spark.read.schema("value string").text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    state = F.from_json("value", "lastCount bigint, lastExtracted string")
    row = table.select(F.coalesce(F.max(state["lastCount"]), F.lit(0))).first()
    return int(row[0])


def write_position(records: DataFrame, path: str) -> None:
    """Store how far the extract has come: the highest position read, before any filter."""
    records.agg(F.coalesce(F.max("position"), F.lit(0)).alias("lastCount")).select(
        F.to_json(
            F.struct("lastCount", iso_utc(F.current_timestamp()).alias("lastExtracted"))
        ).alias("value")
    ).coalesce(1).write.mode("overwrite").text(path)

