"""Whole message bytes to HTTP records, and the pairing of responses with requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from apilens.functions import http
from apilens.operators.reassembly import IDLE_SECONDS
from apilens.sources.segments import flow_key


def parse_messages(
    raw: DataFrame, host_case_sensitive: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    """Split message bytes into line, headers and body; one native projection, no Python.

    Input: flow columns, ``ts``, ``seq``, ``n``, ``message``. Incomplete or malformed messages get
    ``type`` null; see :func:`http_records` and :func:`malformed`. ``keep`` names further columns
    to pass through.
    """
    message = F.col("message")
    # Columns that several later ones use get a projection of their own, so that each is computed
    # once. The result passes through a generator for the same reason: a filter on it would
    # otherwise be pushed below the parsing and repeat all of it.
    sized = raw.withColumn("head_length", http.header_length(message))
    opened = sized.withColumn("head", http.header_text(message, F.col("head_length")))
    line = http.start_line(F.col("head"))
    split = opened.select(
        "*",
        http.content_length(F.col("head")).alias("length"),
        F.when(http.is_http_request(F.col("head")), http.request_line(line)).alias("req"),
        F.when(http.is_http_response(F.col("head")), http.status_line(line)).alias("res"),
        http.header_pairs(F.col("head")).alias("pairs"),
    )
    named = split.withColumn("headers", http.header_map(F.col("pairs")))
    body = http.message_body(message, F.col("head_length"), F.col("length"))
    whole = F.length(message) >= F.col("head_length") + F.coalesce(F.col("length"), F.lit(0))
    is_request = F.col("req").isNotNull() & whole
    is_response = F.col("res").isNotNull() & whole
    record = F.struct(
        F.when(is_request, "request").when(is_response, "response").alias("type"),
        F.col("req.method").alias("method"),
        F.col("req.path").alias("endpoint"),
        F.when(
            is_request,
            http.host_of(F.col("headers"), F.col("dst_ip"), host_case_sensitive),
        ).alias("host"),
        F.col("res.code").alias("status_code"),
        F.col("res.text").alias("status_text"),
        F.coalesce(F.col("req.version"), F.col("res.version")).alias("version"),
        F.col("headers").alias("headers"),
        http.decode_body(body).alias("body"),
    )
    return named.select(
        "node",
        F.col("src_ip").alias("source_ip"),
        F.col("src_port").alias("source_port"),
        F.col("dst_ip").alias("destination_ip"),
        F.col("dst_port").alias("destination_port"),
        "ts",
        "seq",
        "n",
        "message",
        *keep,
        F.inline(F.array(record)),
    )


def http_records(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("type").isNotNull()).drop("message")


def malformed(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("type").isNull())


def refused_messages(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Messages that give no record, with ``reason``: ``start line`` or ``status code`` is none, ``short body`` of a
    method that carries one, otherwise ``incomplete``. Same input and ``keep`` as :func:`parse_messages`."""
    message = F.col("message")
    opened = raw.withColumn("head_length", http.header_length(message)).withColumn(
        "head", http.header_text(message, F.col("head_length"))
    )
    line = http.start_line(F.col("head"))
    sized = opened.select(
        "*",
        http.content_length(F.col("head")).alias("length"),
        http.is_http_request(F.col("head")).alias("asks"),
        http.is_http_response(F.col("head")).alias("answers"),
        http.request_line(line).alias("req"),
        http.status_line(line).alias("res"),
    )
    body = F.substring(message, F.col("head_length") + 1, F.length(message))
    missing = F.length(body) < F.col("length")
    reason = (
        F.when(F.col("head_length").isNull(), "incomplete")
        .when(~F.col("asks") & ~F.col("answers"), "start line")
        .when(F.col("asks") & F.col("req").isNull(), "start line")
        .when(F.col("answers") & F.col("res").isNull(), "status code")
        .when(F.col("asks") & ~http.body_length_ok(F.col("req.method"), body, F.col("length")), "short body")
        .when(missing, "incomplete")
    )
    columns = [c for c in raw.columns if c not in keep]
    return sized.withColumn("reason", reason).filter("reason IS NOT NULL").select(*columns, *keep, "reason")


def record_id() -> Column:
    """Stable id: the same message gets the same id when a task runs again."""
    flow = flow_key(
        F.col("source_ip"), F.col("source_port"), F.col("destination_ip"), F.col("destination_port")
    )
    return F.sha2(
        F.concat_ws("|", F.col("node"), flow, F.unix_micros("ts"), F.col("seq"), F.col("n")), 256
    )


def _connection() -> Column:
    """Key that a request and its response share: the request's direction."""
    forward = flow_key(
        F.col("source_ip"), F.col("source_port"), F.col("destination_ip"), F.col("destination_port")
    )
    backward = flow_key(
        F.col("destination_ip"), F.col("destination_port"), F.col("source_ip"), F.col("source_port")
    )
    return F.concat_ws(
        "|", F.col("node"), F.when(F.col("type") == "request", forward).otherwise(backward)
    )


def correlate(
    records: DataFrame, chunk_seconds: int = 60, idle_seconds: int = IDLE_SECONDS
) -> DataFrame:
    """Give every response the latest earlier request of its connection.

    The request stays available, so several responses may take the same one, but not for longer than
    ``idle_seconds``, for which streams remember it. A response without any gets method ``UNKNOWN``, endpoint ``/`` and its destination address as host.

    The as-of lookup is split in two so that a busy connection is spread over tasks: a window
    inside (connection, time chunk), then the last request of each earlier chunk, carried forward
    over one narrow row per chunk.
    """
    connection, chunk = "_connection", "_chunk"
    request = F.struct(
        F.col("method"), F.col("endpoint"), F.col("host"), F.col("service"), F.col("ts")
    )
    keyed = records.withColumn(connection, _connection()).withColumn(
        chunk, F.floor(F.unix_micros("ts") / F.lit(chunk_seconds * 1_000_000))
    )
    is_request = F.col("type") == "request"
    # A request and a response at the same instant: the request is the earlier one.
    arrival = [F.col("ts"), F.col("type"), F.col("seq"), F.col("n")]
    inside = (
        W.partitionBy(connection, chunk)
        .orderBy(*arrival)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    near = keyed.withColumn(
        "_near", F.last(F.when(is_request, request), ignorenulls=True).over(inside)
    )
    last_of_chunk = keyed.groupBy(connection, chunk).agg(
        F.max_by(F.when(is_request, request), F.when(is_request, F.struct(*arrival))).alias("_last")
    )
    before = (
        W.partitionBy(connection).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    )
    far = last_of_chunk.select(
        connection, chunk, F.last("_last", ignorenulls=True).over(before).alias("_far")
    ).filter(F.col("_far").isNotNull())
    found = near.join(far, [connection, chunk], "left").withColumn(
        "_request", F.coalesce("_near", "_far")
    )
    age = F.unix_micros("ts") - F.unix_micros("_request.ts")
    found = found.withColumn("_request", F.when(age <= idle_seconds * 1_000_000, F.col("_request")))

    def taken(name: str, default: Column) -> Column:
        return (
            F.when(is_request, F.col(name))
            .otherwise(F.coalesce(F.col(f"_request.{name}"), default))
            .alias(name)
        )

    replaced = {
        "method": taken("method", F.lit("UNKNOWN")),
        "endpoint": taken("endpoint", F.lit("/")),
        "host": taken("host", F.col("destination_ip")),
        "service": taken("service", F.col("service")),
    }
    return found.select(*[replaced.get(name, F.col(name)) for name in records.columns])


def to_http_messages(correlated: DataFrame, keep: Sequence[Column | str] = ()) -> DataFrame:
    """Canonical records (:data:`apilens.schemas.HTTP_MESSAGES`), ``keep`` columns appended."""
    is_request = F.col("type") == "request"
    is_response = F.col("type") == "response"
    return correlated.select(
        record_id().alias("id"),
        "type",
        "ts",
        "node",
        "service",
        "method",
        "endpoint",
        F.concat(F.lit("http://"), F.col("host"), F.col("endpoint")).alias("full_url"),
        "host",
        F.lit("HTTP").alias("protocol"),
        "status_code",
        "status_text",
        "source_ip",
        "source_port",
        "destination_ip",
        "destination_port",
        F.when(is_request, F.col("headers")).alias("request_headers"),
        F.when(is_request, F.col("body")).alias("request_body"),
        F.when(is_response, F.col("headers")).alias("response_headers"),
        F.when(is_response, F.col("body")).alias("response_body"),
        "version",
        *keep,
    )
