"""Endpoint catalog: flatten, match requests against templates, decide, apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apilens.functions.paths import (
    catalog_key,
    endpoint_id,
    masked,
    norm_method,
    norm_path,
    parameter_mask,
    path_params,
    path_template,
    query_params,
    strip_query,
)
from apilens.functions.values import clean_body

INSTANCE = ("appId", "instanceId")
ADD, COMMIT, FAIL = "ADD", "COMMIT", "FAIL"


def explode_catalog(listings: DataFrame) -> DataFrame:
    """Nested listings (``appId, instanceId, endpointGroups``) to one row per listed endpoint."""
    groups = listings.select(
        *INSTANCE, F.posexplode("endpointGroups").alias("group_pos", "group")
    )
    return groups.select(
        *INSTANCE, "group_pos", F.posexplode("group.endpoints").alias("endpoint_pos", "endpoint")
    ).select(
        *INSTANCE,
        "group_pos",
        "endpoint_pos",
        norm_method(F.col("endpoint.method")).alias("method"),
        norm_path(F.coalesce("endpoint.path", F.lit(""))).alias("path"),
        F.nullif(F.col("endpoint.id"), F.lit("")).alias("endpoint_id"),
    )


def flatten_catalog(exploded: DataFrame) -> DataFrame:
    """Key ``method:path`` to id: rows without method or id are dropped, the last of a key wins.

    ``max_by`` instead of a ranking window: it combines before the shuffle.
    """
    return (
        exploded.filter((F.col("method") != "") & F.col("endpoint_id").isNotNull())
        .groupBy(*INSTANCE, "method", "path")
        .agg(F.max_by("endpoint_id", F.struct("group_pos", "endpoint_pos")).alias("endpoint_id"))
        .withColumn("catalog_key", catalog_key(F.col("method"), F.col("path")))
    )


def catalog_templates(exploded: DataFrame) -> DataFrame:
    """One row per (instance, method, path) including listed endpoints without id."""
    return (
        exploded.filter(F.col("method") != "")
        .groupBy(*INSTANCE, "method", "path")
        .agg(F.max_by("endpoint_id", F.struct("group_pos", "endpoint_pos")).alias("endpoint_id"))
    )


def match_paths(paths: DataFrame, catalog: DataFrame) -> DataFrame:
    """Best template for each distinct (instance, method, path); paths that none fits are left out.

    A template fits when it has as many segments and agrees on every literal one. Templates of an
    instance and method fall into few shapes (which positions are parameters); the path is blanked
    out once per shape and looked up by equality, so no path meets every template. The fewest
    parameters win, ties go to the smallest template text.
    """
    return _with_best_template(paths.select(*INSTANCE, "method", "path"), catalog, "inner")


def _with_best_template(paths: DataFrame, catalog: DataFrame, how: str) -> DataFrame:
    """``paths``, distinct by (instance, method, path), with ``matched_path`` and ``endpoint_id``; other columns go
    along, so nothing has to be joined back. ``how`` (``inner`` or ``left``) says what happens without a template."""
    keys = [*INSTANCE, "method"]
    others = [c for c in paths.columns if c not in (*keys, "path")]
    shaped = catalog.withColumn("mask", parameter_mask(F.col("path"))).select(
        *keys,
        "mask",
        F.length("mask").alias("segments"),
        masked(F.col("path"), F.col("mask")).alias("masked"),
        F.col("path").alias("template"),
        "endpoint_id",
    )
    shapes = shaped.select(*keys, "segments", "mask").distinct()
    wanted = paths.withColumn("segments", F.size(F.split("path", "/")))
    candidates = wanted.join(shapes, [*keys, "segments"], how).withColumn(
        "masked", masked(F.col("path"), F.col("mask"))
    )
    fits = candidates.join(shaped, [*keys, "segments", "mask", "masked"], how)
    parameters = F.length(F.replace(F.col("mask"), F.lit("="), F.lit("")))
    fitting = F.struct(parameters.alias("parameters"), "template", "endpoint_id")
    best = fits.groupBy(*keys, "path").agg(
        F.min(F.when(F.col("template").isNotNull(), fitting)).alias("best"),
        *(F.any_value(c).alias(c) for c in others),
    )
    return best.select(
        *keys,
        "path",
        F.col("best.template").alias("matched_path"),
        F.col("best.endpoint_id").alias("endpoint_id"),
        *others,
    )


def _endpoint() -> Column:
    """A request without a path asks for the root."""
    return F.coalesce("endpoint", F.lit("/"))


def match_catalog(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``match_path``, ``matched_path`` and ``endpoint_id`` to mapped requests.

    Matching runs on distinct paths; the result returns to the requests by one equi join.
    """
    keyed = requests.withColumn(
        "match_path", norm_path(strip_query(_endpoint()))
    ).withColumn("match_method", norm_method(F.col("method")))
    paths = keyed.select(
        *INSTANCE, F.col("match_method").alias("method"), F.col("match_path").alias("path")
    ).distinct()
    matched = match_paths(paths, catalog).withColumnsRenamed(
        {"method": "match_method", "path": "match_path"}
    )
    joined = keyed.join(matched, [*INSTANCE, "match_method", "match_path"], "left")
    return joined.select(*requests.columns, "match_path", "matched_path", "endpoint_id")


def plan_catalog_actions(matched: DataFrame) -> DataFrame:
    """Decide per request: add a template, commit to the matched endpoint, or fail."""
    matched_path = F.col("matched_path")
    raw_match = path_template(matched_path) != matched_path
    action = (
        F.when(matched_path.isNull(), ADD)
        .when(F.col("endpoint_id").isNull(), FAIL)
        .when(raw_match, ADD)
        .otherwise(COMMIT)
    )
    template = (
        F.when(matched_path.isNull(), path_template(norm_path(_endpoint())))
        .when(F.col("endpoint_id").isNull(), F.lit(None).cast("string"))
        .otherwise(path_template(matched_path))
    )
    return matched.withColumn("action", action).withColumn("template", template)


def match_counts(matched: DataFrame) -> DataFrame:
    return matched.groupBy(*INSTANCE).agg(
        F.count_if(F.col("matched_path").isNotNull()).alias("matched_requests"),
        F.count_if(F.col("matched_path").isNull()).alias("unmatched_requests"),
    )


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("requests"))


def _reduced(actions: DataFrame) -> DataFrame:
    """(keys, new_body, wanted): one row per endpoint that the actions add or update.

    The newest body is found on cleaned bodies before the shuffle, one per endpoint and input partition.
    """
    body = F.nullif(clean_body(F.col("request_body")), F.lit(""))
    return (
        actions.filter(F.col("action") != FAIL)
        .select(
            *INSTANCE,
            norm_method(F.col("method")).alias("method"),
            F.col("template").alias("path"),
            (F.col("action") == ADD).alias("adds"),
            body.alias("body"),
            "ts",
            "id",
        )
        .groupBy(*INSTANCE, "method", "path")
        .agg(
            F.max_by("body", F.when(F.col("body").isNotNull(), F.struct("ts", "id"))).alias("new_body"),
            F.bool_or("adds").alias("wanted"),
        )
    )


def catalog_changes(catalog: DataFrame, actions: DataFrame) -> DataFrame:
    """Only the rows of the catalog that the actions add or update, with their ``status``."""
    keys = [*INSTANCE, "method", "path"]
    known = F.coalesce("listed", F.lit(False))
    return (
        _reduced(actions)
        .join(catalog.withColumn("listed", F.lit(True)), keys, "left")
        .select(
            *INSTANCE,
            F.when(known, F.col("endpoint_id"))
            .otherwise(endpoint_id(F.col("method"), F.col("path")))
            .alias("endpoint_id"),
            "method",
            "path",
            F.coalesce("new_body", "body_example").alias("body_example"),
            F.when(known, "updated").otherwise("added").alias("status"),
        )
    )


def apply_to_catalog(catalog: DataFrame, actions: DataFrame) -> DataFrame:
    """Catalog after the actions: missing templates added, matched endpoints updated.

    ``catalog`` has the columns of :data:`apilens.schemas.CATALOG`. Requests are reduced to one
    row per endpoint first; the newest body of an endpoint is kept as its example.
    """
    return _merged(catalog, _reduced(actions))


def _merged(catalog: DataFrame, reduced: DataFrame) -> DataFrame:
    keys = [*INSTANCE, "method", "path"]
    known = F.coalesce("listed", F.lit(False))
    joined = catalog.withColumn("listed", F.lit(True)).join(reduced, keys, "full")
    return (
        joined.withColumn(
            "status",
            F.when(~known, "added").when(F.col("wanted").isNotNull(), "updated").otherwise("kept"),
        )
        .select(
            *INSTANCE,
            F.when(known, F.col("endpoint_id"))
            .otherwise(endpoint_id(F.col("method"), F.col("path")))
            .alias("endpoint_id"),
            "method",
            "path",
            F.coalesce("new_body", "body_example").alias("body_example"),
            "status",
        )
    )


def upsert_catalog(catalog: DataFrame, templates: DataFrame, requests: DataFrame) -> DataFrame:
    """What :func:`apply_to_catalog` gives for the actions of these mapped requests, without a row per request.

    Requests are reduced to the newest body of every path before anything else, on the side of the scan; only these rows
    are matched, decided, and reduced once more to endpoints. No request and no second body of a path meets a join, so
    a path that is asked for very often is one row per input partition.
    """
    body = F.nullif(clean_body(F.col("request_body")), F.lit(""))
    newest = F.when(F.col("body").isNotNull(), F.struct("ts", "id"))
    paths = (
        requests.select(
            *INSTANCE,
            norm_method(F.col("method")).alias("method"),
            norm_path(strip_query(_endpoint())).alias("path"),
            body.alias("body"),
            "ts",
            "id",
        )
        .groupBy(*INSTANCE, "method", "path")
        .agg(F.max_by(F.struct("body", "ts", "id"), newest).alias("newest"))
    )
    matched = _with_best_template(paths, templates, "left")
    decided = plan_catalog_actions(matched.withColumn("endpoint", F.col("path"))).filter(F.col("action") != FAIL)
    reduced = decided.groupBy(*INSTANCE, "method", F.col("template").alias("path")).agg(
        F.max_by("newest.body", F.when(F.col("newest").isNotNull(), F.struct("newest.ts", "newest.id"))).alias("new_body"),
        F.lit(True).alias("wanted"),
    )
    return _merged(catalog, reduced)


def endpoint_parameters(actions: DataFrame) -> DataFrame:
    """Parameters and headers seen on committed endpoints: one row per name, newest value.

    Rows instead of a map per endpoint, so that an endpoint with very many names stays spread out.
    """
    commits = actions.filter(F.col("action") == COMMIT)

    def tagged(kind: str, pairs):
        return F.transform(
            pairs,
            lambda p: F.struct(
                F.lit(kind).alias("kind"), p["name"].alias("name"), p["value"].alias("value")
            ),
        )

    headers = F.transform(
        F.map_entries("request_headers"),
        lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")),
    )
    seen = F.concat(
        tagged("query", query_params(F.col("endpoint"))),
        tagged("path", path_params(F.col("matched_path"), F.col("match_path"))),
        tagged("header", F.coalesce(headers, F.array())),
    )
    return (
        commits.select(*INSTANCE, "endpoint_id", "ts", "id", F.inline(seen))
        .groupBy(*INSTANCE, "endpoint_id", "kind", "name")
        .agg(
            F.max_by("value", F.struct("ts", "id", "value")).alias("value"),
            F.count("*").alias("times_seen"),
        )
    )


def parameter_changes(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Only the stored parameters that a batch touches, as :func:`apply_parameters` leaves them."""
    keys = [*INSTANCE, "endpoint_id", "kind", "name"]
    old, new = stored.alias("old"), seen.alias("new")
    same = [F.col(f"new.{key}") == F.col(f"old.{key}") for key in keys]
    none = F.lit(0).cast("bigint")
    return new.join(old, same, "left").select(
        *[F.col(f"new.{key}").alias(key) for key in keys],
        F.coalesce("new.value", "old.value").alias("value"),
        (F.coalesce("old.times_seen", none) + F.col("new.times_seen")).alias("times_seen"),
    )


def apply_parameters(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored parameters after a batch: the newest value of a name counts, the times it was seen add up.

    Both have the columns of :func:`endpoint_parameters`; the table stands beside the catalog, keyed by
    endpoint, kind and name.
    """
    keys = [*INSTANCE, "endpoint_id", "kind", "name"]
    old, new = stored.alias("old"), seen.alias("new")
    same = F.lit(True)
    for key in keys:
        same = same & (F.col(f"old.{key}") == F.col(f"new.{key}"))
    none = F.lit(0).cast("bigint")
    return old.join(new, same, "full").select(
        *[F.coalesce(f"new.{key}", f"old.{key}").alias(key) for key in keys],
        F.coalesce("new.value", "old.value").alias("value"),
        (F.coalesce("old.times_seen", none) + F.coalesce("new.times_seen", none)).alias("times_seen"),
    )
