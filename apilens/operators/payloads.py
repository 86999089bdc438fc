"""Exchange documents as JSON columns; one document per row, built by native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apilens.functions.paths import norm_method, norm_path
from apilens.functions.values import blank_to_null, clean_body

_NO_HEADERS = "map<string,string>"


def _headers() -> Column:
    return F.coalesce("request_headers", F.create_map().cast(_NO_HEADERS))


def _body() -> Column:
    return blank_to_null(clean_body(F.col("request_body")))


def _pairs_to_map(pairs: Column) -> Column:
    """Name/value array as a map, the last value of a name wins."""
    names = F.transform(pairs, lambda p: p["name"])
    return F.map_from_entries(
        F.filter(
            pairs, lambda p, at: ~F.array_contains(F.slice(names, at + 2, 1 << 30), p["name"])
        )
    )


def match_request_json(requests: DataFrame) -> DataFrame:
    """``{"requests":[{method, url, requestHeaders, requestBody?}]}``"""
    item = F.struct(
        F.upper("method").alias("method"),
        norm_path(F.col("endpoint")).alias("url"),
        _headers().alias("requestHeaders"),
        _body().alias("requestBody"),
    )
    return requests.select("id", F.to_json(F.struct(F.array(item).alias("requests"))).alias("document"))


def add_request_json(actions: DataFrame) -> DataFrame:
    """``[{method, endpoint, payload}]`` for the requests that add a template."""
    item = F.struct(
        norm_method(F.col("method")).alias("method"),
        norm_path(F.col("template")).alias("endpoint"),
        F.coalesce(_body(), F.lit("")).alias("payload"),
    )
    return actions.filter("action = 'ADD'").select(
        "id", F.to_json(F.array(item)).alias("document")
    )


def commit_request_json(actions: DataFrame) -> DataFrame:
    """``{applyRequestBodies, endpoints[]}`` for the requests that commit.

    Needs ``path_params`` and ``query_params`` (name/value arrays) on the actions.
    """
    example = F.when(
        _body().isNotNull(),
        F.struct(
            F.coalesce(
                F.try_element_at("request_headers", F.lit("Content-Type")),
                F.lit("application/json"),
            ).alias("contentType"),
            _body().alias("content"),
        ),
    )
    item = F.struct(
        F.col("endpoint_id").alias("endpointId"),
        F.lit(True).alias("include"),
        _pairs_to_map(F.col("path_params")).alias("pathParams"),
        _pairs_to_map(F.col("query_params")).alias("queryParams"),
        _headers().alias("headers"),
        example.alias("requestBodyExample"),
    )
    document = F.struct(F.lit(True).alias("applyRequestBodies"), F.array(item).alias("endpoints"))
    return actions.filter("action = 'COMMIT'").select("id", F.to_json(document).alias("document"))


def update_request_json(endpoints: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``{eventType, eventData{queryParams?, requestBody?}}`` per endpoint.

    Needs ``endpoint_id``, ``query_params`` and ``request_body``; ``keep`` columns stay.
    """
    body = F.when(
        _body().isNotNull(),
        F.struct(F.lit("JSON").alias("contentType"), _body().alias("content")),
    )
    data = F.struct(
        F.when(F.size("query_params") > 0, F.col("query_params")).alias("queryParams"),
        body.alias("requestBody"),
    )
    document = F.struct(F.lit("UPDATE").alias("eventType"), data.alias("eventData"))
    return endpoints.select("endpoint_id", *keep, F.to_json(document).alias("document"))
