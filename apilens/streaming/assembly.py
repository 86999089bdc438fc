"""Segments to paired records, micro-batch by micro-batch, on the batch plans.

The keyed stream in :mod:`apilens.streaming.capture` answers with low delay, but calls Python once
per connection and keeps a connection's part of a micro-batch in one task. Here the batch operators
run on every micro-batch instead: busy connections are spread over tasks and the framing is one
sorted pass. What has to be remembered - open bytes per flow, last request per connection - is a
stored table with one version per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from apilens.operators.messages import correlate, http_records, parse_messages, to_http_messages
from apilens.operators.reassembly import (
    IDLE_SECONDS,
    OPEN_FLOWS,
    RECENT,
    flow_columns,
    messages_only,
    reassemble_onto,
)
from apilens.operators.services import with_service
from apilens.sources.captures import write_captures
from apilens.sources.segments import COPY_GAP_SECONDS, FLOW
from apilens.staging import staged

_ENDS = ("node", "source_ip", "source_port", "destination_ip", "destination_port")
# Arrival order first: the greatest row of a connection is its last request.
_REQUEST = (
    "ts timestamp, seq bigint, n int, node string, source_ip string, source_port int, "
    "destination_ip string, destination_port int, type string, method string, endpoint string, "
    "host string, version string, service string"
)


def _version(root: str, name: str, number: int) -> str:
    return f"{root}/{name}/batch={number}"


def start_state(spark: SparkSession, root: str) -> None:
    """Empty state, which the first micro-batch (number 0) starts from."""
    spark.createDataFrame([], OPEN_FLOWS).write.parquet(_version(root, "open", -1))
    spark.createDataFrame([], _REQUEST).write.parquet(_version(root, "requests", -1))
    spark.createDataFrame([], RECENT).write.parquet(_version(root, "recent", -1))


def _recent_segments(batch: DataFrame, recent: DataFrame, newest: int) -> DataFrame:
    """What copies in later micro-batches are recognised by."""
    seen = batch.select(
        *FLOW, "seq", F.md5("payload").alias("digest"), F.unix_micros("ts").alias("last_us")
    ).unionByName(recent)
    last = seen.filter(F.col("seq").isNotNull() & (F.col("last_us") >= newest - COPY_GAP_SECONDS * 1_000_000))
    return last.groupBy(*FLOW, "seq", "digest").agg(F.max("last_us").alias("last_us"))


def assemble_batch(
    root: str, captures: str, directory: Callable[[], DataFrame], idle_seconds: int = IDLE_SECONDS
) -> Callable[[DataFrame, int], None]:
    """Micro-batch function: state version ``n - 1`` and the segments give records and version ``n``.

    A repeated micro-batch writes the same again. State of flows and connections that have been
    silent for ``idle_seconds`` is dropped, and the open bytes of such flows are written to the
    ``expired`` table of the version as rows of kind ``open``; a flow that goes on after such a silence starts anew, as
    in the batch plan. What a flow had begun before such a silence and bytes that are no message go to the
    ``unframed`` table of the version. Nothing is thrown away: see :func:`leftovers`.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.agg(F.unix_micros(F.max("ts"))).first()[0] or 0
        oldest = newest - idle_seconds * 1_000_000
        open_flows = spark.read.schema(OPEN_FLOWS).parquet(_version(root, "open", number - 1))
        recent = spark.read.schema(RECENT).parquet(_version(root, "recent", number - 1))
        _recent_segments(batch, recent, newest).write.mode("overwrite").parquet(
            _version(root, "recent", number)
        )
        framed, left = reassemble_onto(
            batch, open_flows, idle_seconds=idle_seconds, copy_gap_seconds=COPY_GAP_SECONDS, recent=recent
        )
        left = staged(left, "left")
        left.filter(F.col("ts_us") >= oldest).write.mode("overwrite").parquet(
            _version(root, "open", number)
        )
        expired = left.filter(F.col("ts_us") < oldest).select(
            "flow", "ts_us", F.lit("open").alias("kind"), F.expr("substring(state, 2)").alias("message")
        )
        expired.filter(F.length("message") > 0).write.mode("overwrite").parquet(
            _version(root, "expired", number)
        )
        framed.filter("kind <> 'message'").write.mode("overwrite").parquet(_version(root, "unframed", number))
        parsed = http_records(parse_messages(messages_only(framed)))
        fresh = with_service(parsed, directory()).withColumn("old", F.lit(False))
        remembered = (
            spark.read.schema(_REQUEST)
            .parquet(_version(root, "requests", number - 1))
            .withColumn("old", F.lit(True))
        )
        records = staged(fresh.unionByName(remembered, allowMissingColumns=True), "records")
        paired = correlate(records, idle_seconds=idle_seconds).filter(~F.col("old"))
        write_captures(to_http_messages(paired), f"{captures}/batch={number}", "overwrite")
        names = [part.split()[0] for part in _REQUEST.split(", ")]
        records.filter("type = 'request'").filter(F.unix_micros("ts") >= oldest).groupBy(
            *_ENDS
        ).agg(F.max(F.struct(*names)).alias("r")).select(
            *[F.col(f"r.{name}") for name in names]
        ).write.mode("overwrite").parquet(_version(root, "requests", number))

    return run


def leftovers(spark: SparkSession, root: str, last: int) -> DataFrame:
    """Unfinished and rejected bytes of the versions up to ``last``: flow columns, ``ts``, ``kind``, ``data``.

    What is open still, and may go on, is in the ``open`` table of the last version.
    """
    versions = range(last + 1)
    columns = (*FLOW, "ts", "kind", "data")
    unframed = spark.read.parquet(*(_version(root, "unframed", n) for n in versions)).select(*columns)
    expired = spark.read.parquet(*(_version(root, "expired", n) for n in versions))
    named = flow_columns(expired.withColumnRenamed("message", "data"))
    return unframed.unionByName(named.select(*columns))


def assemble_batches(
    segments: DataFrame,
    root: str,
    captures: str,
    checkpoint: str,
    directory: Callable[[], DataFrame],
    idle_seconds: int = IDLE_SECONDS,
) -> StreamingQuery:
    return (
        segments.writeStream.foreachBatch(
            assemble_batch(root, captures, directory, idle_seconds)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
