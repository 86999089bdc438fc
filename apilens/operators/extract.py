"""Batch extract over stored records: filters, projection, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apilens.functions.values import blank_to_null, iso_utc

# Paths of health checks.
HEALTH_PATHS = (
    "/health", "/healthz", "/ready", "/readiness", "/live", "/liveness", "/ping", "/status",
)

# The exact path ignores case; below a path (or with a query) case counts.
_NAMES = "|".join(HEALTH_PATHS)
_HEALTH = rf"^(?:(?i:(?:{_NAMES}))\z|(?:{_NAMES})[/?])"


def is_health_check(endpoint: Column) -> Column:
    return endpoint.rlike(_HEALTH)


def drop_health_checks(records: DataFrame) -> DataFrame:
    """Without health checks and without records that name no endpoint."""
    endpoint = F.col("endpoint")
    return records.filter((endpoint != "") & ~is_health_check(endpoint))


def new_since(records: DataFrame, position: int | Column) -> DataFrame:
    """Records after an extract position; positions are given before any filter."""
    return records.filter(F.col("position") > position)


def project_extract(records: DataFrame) -> DataFrame:
    """Ordered report fields; status on responses only, empty fields null."""
    is_response = F.col("type") == "response"

    def filled(headers: str) -> Column:
        return F.when(F.size(headers) > 0, F.col(headers))

    return records.select(
        "id",
        iso_utc(F.col("ts")).alias("timestamp"),
        F.when(is_response & (F.col("status_code") != 0), F.col("status_code")).alias(
            "status_code"
        ),
        F.when(is_response, blank_to_null(F.col("status_text"))).alias("status_text"),
        blank_to_null(F.col("service")).alias("service"),
        "method",
        "endpoint",
        "full_url",
        "type",
        F.coalesce(filled("request_headers"), filled("response_headers")).alias("headers"),
        blank_to_null(F.col("request_body")).alias("request_body"),
        blank_to_null(F.col("response_body")).alias("response_body"),
    )


def extract_metadata(
    records: DataFrame,
    skip_health_checks: bool = True,
    last_position: int | Column | None = None,
) -> DataFrame:
    """One row: counts before and after the filters, and the node of the first extracted record."""
    endpoint = F.col("endpoint")
    healthy = F.coalesce((endpoint != "") & ~is_health_check(endpoint), F.lit(False))
    passes = healthy if skip_health_checks else F.lit(True)
    fresh = F.lit(True) if last_position is None else F.col("position") > last_position
    kept = passes & fresh
    return records.agg(
        F.count_if(kept).alias("total_endpoints"),
        F.count("*").alias("total_in_file"),
        F.count_if(~passes).alias("dropped_health_checks"),
        F.coalesce(
            F.min_by("node", F.when(kept, F.col("position"))), F.lit("unknown")
        ).alias("node"),
    ).select(
        "*",
        F.lit(skip_health_checks).alias("filtered_health_checks"),
        F.lit(last_position is not None).alias("new_only"),
    )


def summary_by_type(records: DataFrame) -> DataFrame:
    return records.groupBy("type").agg(F.count("*").alias("records"))


def summary_by_method(records: DataFrame) -> DataFrame:
    """Requests per method; methods are grouped without regard to case."""
    return (
        records.filter("type = 'request'")
        .groupBy(F.upper("method").alias("method"))
        .agg(F.count("*").alias("records"))
    )


def summary_by_status(records: DataFrame) -> DataFrame:
    return (
        records.filter("type = 'response'")
        .groupBy("status_code")
        .agg(F.count("*").alias("records"))
    )


def summary_onepass(records: DataFrame) -> DataFrame:
    """The three summaries from one scan and one shuffle.

    Rows are first reduced to (type, method, status) counts, of which there are few.
    """
    is_request = F.col("type") == "request"
    counted = records.groupBy(
        "type",
        F.when(is_request, F.upper("method")).alias("method"),
        F.when(~is_request, F.col("status_code")).alias("status_code"),
    ).agg(F.count("*").alias("n"))
    entries = F.array(
        F.struct(F.lit("type").alias("summary"), F.col("type").alias("value")),
        F.when(
            is_request, F.struct(F.lit("method").alias("summary"), F.col("method").alias("value"))
        ).otherwise(
            F.struct(
                F.lit("status").alias("summary"), F.col("status_code").cast("string").alias("value")
            )
        ),
    )
    return (
        counted.select("n", F.inline(entries))
        .groupBy("summary", "value")
        .agg(F.sum("n").alias("records"))
    )


def unique_endpoints(records: DataFrame) -> DataFrame:
    return records.filter("type = 'request'").select("endpoint", "method").distinct()


def unique_endpoint_count(records: DataFrame) -> DataFrame:
    """One row: how many different endpoints were asked for; a request without endpoint counts as one."""
    return unique_endpoints(records).agg(F.count("*").alias("unique_endpoints"))


def sample_endpoints(records: DataFrame, size: int) -> DataFrame:
    """The first distinct endpoints by (endpoint, method), for the report's preview lines."""
    return (
        records.filter((F.col("type") == "request") & (F.col("endpoint") != ""))
        .select("endpoint", "method")
        .distinct()
        .orderBy("endpoint", "method")
        .limit(size)
    )
