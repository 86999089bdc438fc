"""Every operator as a query over the test tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apilens import schemas
from apilens.functions import http
from apilens.functions.hosts import is_cluster_traffic, is_inter_service
from apilens.functions.paths import (
    catalog_key,
    endpoint_id,
    norm_path,
    path_params,
    path_template,
    query_params,
)
from apilens.functions.values import clean_body, preview
from apilens.operators import (
    catalog,
    entities,
    extract,
    inventory,
    messages,
    onboarding,
    payloads,
    reassembly,
    services,
)
from apilens.plans import capture_view as view
from apilens.sources import captures, committed, documents, segments
from apilens.staging import staged, staging_path
from apilens.streaming import assembly as stream_assembly
from apilens.streaming import capture as stream_capture
from apilens.streaming import catalog as stream_catalog_jobs
from apilens.streaming import extract as stream_extract

Query = Callable[[SparkSession, str], DataFrame]

_REPORT = (
    "id string, timestamp string, status_code int, status_text string, service string, "
    "method string, endpoint string, full_url string, type string, "
    "headers map<string,string>, request_body string, response_body string"
)
_QUERIES: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _us(column: str = "ts", name: str = "ts_us"):
    return F.unix_micros(column).alias(name)


def _record_columns(df: DataFrame) -> DataFrame:
    """Records in comparable form: time as microseconds, headers as JSON."""
    return df.select(
        *[
            _us()
            if c == "ts"
            else F.to_json(c).alias(c)
            if c in ("request_headers", "response_headers")
            else F.col(c)
            for c in df.columns
        ]
    )


# Inventory and paths


@_query
def endpoint_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = extract.drop_health_checks(view.attributed_requests(spark, sf_dir))
    return inventory.endpoint_inventory(kept).select(
        "service", "method", "template", "hits", "raw_paths",
        _us("first_seen", "first_seen_us"), _us("last_seen", "last_seen_us"),
    )


@_query
def path_template_of_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.requests_view(spark, sf_dir).select(
        "event_id", "endpoint", path_template(norm_path(F.col("endpoint"))).alias("template")
    )


@_query
def page_path_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://[^/]*", "")
    return view.table(spark, sf_dir, "pages").select(
        "page_id", path_template(norm_path(path)).alias("template")
    )


@_query
def endpoint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    method, path = F.col("method"), norm_path(F.col("endpoint"))
    return view.requests_view(spark, sf_dir).select(
        "event_id",
        endpoint_id(method, path).alias("endpoint_id"),
        catalog_key(method, path).alias("catalog_key"),
    )


@_query
def query_params_of_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.requests_view(spark, sf_dir).select(
        "event_id", F.inline(query_params(F.col("endpoint")))
    )


# Filters


@_query
def http_port_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.http_port_filter(
        view.requests_view(spark, sf_dir), source="source_port", destination="destination_port"
    ).select("event_id", "source_port", "destination_port")


@_query
def packet_port_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.http_port_filter(
        view.requests_view(spark, sf_dir), segments.PACKET_PORTS, "source_port", "destination_port"
    ).select("event_id", "source_port", "destination_port")


@_query
def raw_socket_port_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.http_port_filter(
        view.requests_view(spark, sf_dir), segments.RAW_SOCKET_PORTS, "source_port", "destination_port"
    ).select("event_id", "source_port", "destination_port")


@_query
def cluster_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.messages_view(spark, sf_dir).select(
        "position",
        is_cluster_traffic(F.col("source_ip"), F.col("destination_ip")).alias("cluster"),
    )


@_query
def inter_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.requests_view(spark, sf_dir).filter(
        is_inter_service(F.col("host_header"), F.col("destination_ip"))
    ).select("event_id", F.col("host_header").alias("host"))


@_query
def interface_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node sees no preferred interface and falls back to all but loopback."""
    seen = view.requests_view(spark, sf_dir).withColumn(
        "iface",
        F.when((F.col("event_id") % 3 == 2) & (F.col("iface") != "lo"), "wlan0").otherwise(
            F.col("iface")
        ),
    )
    return segments.select_interfaces(seen.select("event_id", "node", "iface")).select(
        "event_id", "node", "iface"
    )


@_query
def drop_health_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.drop_health_checks(view.requests_view(spark, sf_dir)).select(
        "event_id", "method", "endpoint"
    )


# Attribution, pairing, mapping


@_query
def service_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.attributed_view(spark, sf_dir).select(
        "position", "type", "host", "destination_ip", "service"
    )


@_query
def correlate_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.correlate(view.attributed_view(spark, sf_dir)).select(
        "position", "type", "method", "endpoint", "host", "service", "status_code"
    )


@_query
def http_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record_columns(view.http_messages_view(spark, sf_dir))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.catalog_candidates(view.attributed_requests(spark, sf_dir))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.map_services(_requests(spark, sf_dir), view.mappings_view(spark, sf_dir))


@_query
def mapped_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("id", "service", "appId", "instanceId")


@_query
def configured_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = view.attributed_requests(spark, sf_dir).select("service").distinct()
    return services.configured_services(seen, view.mappings_view(spark, sf_dir))


def _unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.unmapped_services(_requests(spark, sf_dir), view.mappings_view(spark, sf_dir))


@_query
def unmapped_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unmapped(spark, sf_dir)


@_query
def service_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.service_coverage(
        view.attributed_requests(spark, sf_dir), view.mappings_view(spark, sf_dir)
    )


@_query
def overlay_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.mappings_view(spark, sf_dir)


@_query
def merge_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.merge_mappings(
        view.saved_mappings(spark, sf_dir), view.base_mappings(spark, sf_dir)
    )


@_query
def mapping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.mapping_counts(view.mappings_view(spark, sf_dir))


# Extract and summary


@_query
def summary_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.summary_by_type(view.messages_view(spark, sf_dir))


@_query
def summary_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.summary_by_method(view.messages_view(spark, sf_dir))


@_query
def summary_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.summary_by_status(view.messages_view(spark, sf_dir))


@_query
def summary_onepass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.summary_onepass(view.messages_view(spark, sf_dir))


@_query
def unique_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.unique_endpoints(view.messages_view(spark, sf_dir))


@_query
def unique_endpoint_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.unique_endpoint_count(view.messages_view(spark, sf_dir))


@_query
def sample_endpoints_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.sample_endpoints(view.messages_view(spark, sf_dir), 3)


@_query
def sample_endpoints_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = extract.drop_health_checks(view.messages_view(spark, sf_dir))
    return extract.sample_endpoints(kept, 5)


def _positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their position in the capture."""
    paired = messages.correlate(view.attributed_view(spark, sf_dir))
    position = (
        F.col("seq") * 2 + F.when(F.col("type") == "response", 1).otherwise(0)
    ).alias("position")
    return messages.to_http_messages(paired, keep=[position])


def _projected(records: DataFrame) -> DataFrame:
    return extract.project_extract(records).withColumn("headers", F.to_json("headers"))


@_query
def extract_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projected(extract.drop_health_checks(view.http_messages_view(spark, sf_dir)))


@_query
def extract_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_metadata(_positioned(spark, sf_dir))


@_query
def extract_metadata_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of what comes after the half-way position."""
    stored = (
        view.messages_view(spark, sf_dir)
        .agg((F.max("position") / 2).cast("bigint").alias("position"))
        .scalar()
    )
    return extract.extract_metadata(_positioned(spark, sf_dir), last_position=stored)


@_query
def incremental_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes after the half-way position of the capture."""
    stored = (
        view.messages_view(spark, sf_dir)
        .agg((F.max("position") / 2).cast("bigint").alias("position"))
        .scalar()
    )
    records = extract.new_since(_positioned(spark, sf_dir), stored)
    return _projected(extract.drop_health_checks(records))


@_query
def incremental_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures written twice; the second extract goes on from the position stored by the first."""
    root = staging_path(spark, "positions")
    records = staged(_positioned(spark, sf_dir), "records")
    half = records.agg((F.max("position") / 2).cast("bigint").alias("position")).scalar()
    captures.write_captures(records.filter(F.col("position") <= half).drop("position"), f"{root}/captures")
    captures.write_position(captures.read_positioned_captures(spark, f"{root}/captures"), f"{root}/position")
    captures.write_captures(records.filter(F.col("position") > half).drop("position"), f"{root}/captures")
    later = captures.read_positioned_captures(spark, f"{root}/captures")
    new = extract.new_since(later, captures.read_position(spark, f"{root}/position"))
    return _projected(extract.drop_health_checks(new))


@_query
def unknown_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of customers and of ids that no user has."""
    changes = view.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return entities.unknown_changes(view.users_view(spark, sf_dir), changes)


@_query
def extract_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position state written and read back."""
    records = view.messages_view(spark, sf_dir)
    path = staging_path(spark, "position")
    captures.write_position(records, path)
    return records.agg(
        F.lit(captures.read_position(spark, path)).cast("bigint").alias("last_count"),
        F.count("*").alias("records"),
    )


# Catalog


@_query
def catalog_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.flatten_catalog(view.catalog_view(spark, sf_dir))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = catalog.catalog_templates(view.catalog_view(spark, sf_dir))
    return catalog.match_catalog(_mapped(spark, sf_dir), templates)


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.plan_catalog_actions(_matched(spark, sf_dir))


@_query
def catalog_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select(
        "id", "appId", "instanceId", "method", "match_path", "matched_path", "endpoint_id"
    )


@_query
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.match_counts(_matched(spark, sf_dir))


@_query
def catalog_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _actions(spark, sf_dir).select("id", "action", "template", "endpoint_id")


@_query
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.action_counts(_actions(spark, sf_dir))


@_query
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = catalog.flatten_catalog(view.catalog_view(spark, sf_dir)).withColumn(
        "body_example", F.lit(None).cast("string")
    )
    templates = catalog.catalog_templates(view.catalog_view(spark, sf_dir))
    return catalog.upsert_catalog(listed, templates, _mapped(spark, sf_dir))


@_query
def catalog_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from one action per request."""
    listed = catalog.flatten_catalog(view.catalog_view(spark, sf_dir)).withColumn(
        "body_example", F.lit(None).cast("string")
    )
    return catalog.apply_to_catalog(listed, _actions(spark, sf_dir))


@_query
def endpoint_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.endpoint_parameters(_actions(spark, sf_dir))


@_query
def parameters_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of the first half of the time stored, those of the second half applied."""
    actions = staged(_actions(spark, sf_dir), "actions")
    middle = actions.agg(F.timestamp_micros(((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2).cast("bigint"))).scalar()
    before = staged(catalog.endpoint_parameters(actions.filter(F.col("ts") <= middle)), "parameters")
    return catalog.apply_parameters(before, catalog.endpoint_parameters(actions.filter(F.col("ts") > middle)))


@_query
def path_params_of_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _actions(spark, sf_dir).select(
        "id", F.inline(path_params(F.col("matched_path"), F.col("match_path")))
    )


@_query
def payload_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.match_request_json(_mapped(spark, sf_dir))


@_query
def payload_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.add_request_json(_actions(spark, sf_dir))


def _with_params(actions: DataFrame) -> DataFrame:
    return actions.withColumn(
        "path_params", path_params(F.col("matched_path"), F.col("match_path"))
    ).withColumn("query_params", query_params(F.col("endpoint")))


@_query
def payload_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.commit_request_json(_with_params(_actions(spark, sf_dir)))


@_query
def payload_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _with_params(_actions(spark, sf_dir)).filter("action = 'COMMIT'")
    return payloads.update_request_json(commits, keep=["id"]).select("id", "document")


# Onboarding


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onboarding.plan_onboarding(
        _unmapped(spark, sf_dir), view.applications_view(spark, sf_dir), auto_onboard=True
    )


@_query
def onboarding_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@_query
def onboarded_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onboarding.onboarded_mappings(_plan(spark, sf_dir))


@_query
def instance_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onboarding.instance_request_json(_plan(spark, sf_dir))


@_query
def empty_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onboarding.empty_spec_json(_plan(spark, sf_dir))


# Packets, segments, messages


def _parsed_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "node", "source_ip", "source_port", "destination_ip", "destination_port", _us(), "type",
        "method", "endpoint", "host", "status_code", "status_text",
        F.to_json("headers").alias("headers"), "body",
    )


@_query
def parse_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view.rendered_view(spark, sf_dir).drop("type")
    return _parsed_columns(messages.http_records(messages.parse_messages(raw)))


@_query
def decode_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = staged(view.packets_view(spark, sf_dir), "packets")
    return segments.decode_packets(stored).select(
        _us(), "node", "iface", "src_ip", "src_port", "dst_ip", "dst_port", "seq",
        F.hex("payload").alias("payload"),
    )


@_query
def non_empty_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored segments, of which those of every fifth event carry nothing."""
    event = F.floor(F.col("seq") / 100_000)
    payload = F.when(event % 5 == 0, F.unhex(F.lit(""))).otherwise(F.col("payload"))
    path = staging_path(spark, "segments")
    view.segments_view(spark, sf_dir).withColumn("payload", payload).drop("type").write.parquet(path)
    return segments.read_segments(spark, path).select(_us(), "node", "iface", "src_ip", "seq", F.hex("payload").alias("payload"))


@_query
def dedup_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments left per message."""
    unique = segments.dedup_segments(view.segments_view(spark, sf_dir))
    event = F.floor(F.col("seq") / 100_000).cast("bigint")
    is_response = F.col("dst_ip").startswith("10.244.").cast("bigint")
    return unique.groupBy((event * 2 + is_response).alias("position")).agg(
        F.count("*").alias("segments")
    )


def _messages_of(segment_table: DataFrame) -> DataFrame:
    framed = reassembly.reassemble(segment_table, copy_gap_seconds=segments.COPY_GAP_SECONDS)
    return messages.http_records(
        messages.parse_messages(reassembly.messages_only(framed))
    )


@_query
def reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed_columns(_messages_of(view.segments_view(spark, sf_dir)))


@_query
def messages_from_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Port filter, copy removal, reassembly, parsing, attribution and pairing in one plan."""
    wanted = segments.http_port_filter(view.segments_view(spark, sf_dir))
    attributed = services.with_service(_messages_of(wanted), view.directory_view(spark, sf_dir))
    return _paired_columns(messages.to_http_messages(messages.correlate(attributed)))


def _paired_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "type", _us(), "node", "service", "method", "endpoint", "host", "status_code", "source_ip",
        "source_port", "destination_ip", "destination_port", "request_body", "response_body",
    )


@_query
def long_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads that go on for an hour, in chunks of a minute, each followed by one short answer."""
    framed = reassembly.reassemble(
        view.long_download_segments(spark, sf_dir), copy_gap_seconds=segments.COPY_GAP_SECONDS
    )
    return framed.select(
        "src_ip", "src_port", "kind", _us(), F.length("data").cast("bigint").alias("bytes"), F.md5("data").alias("digest")
    )


@_query
def capture_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "captures")
    captures.write_captures(view.http_messages_view(spark, sf_dir), path, "overwrite")
    return _record_columns(captures.read_captures(spark, path))


@_query
def log_line_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "log")
    captures.to_log_lines(view.http_messages_view(spark, sf_dir)).write.text(path)
    return _record_columns(captures.read_capture_log(spark, path))


@_query
def message_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, some cut short: bytes needed, and whether they are all there."""
    cut = F.when(F.col("seq") % 5 == 0, F.length("message") - 1).otherwise(
        F.when(F.col("seq") % 5 == 1, 10).otherwise(F.length("message"))
    )
    part = F.substring("message", F.lit(1), cut)
    return view.rendered_view(spark, sf_dir).select(
        "type", "seq", http.message_length(part).alias("needed"),
        http.is_complete(part).alias("complete"),
    )


@_query
def malformed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start lines without a second word, status codes that are no numbers, cut bodies."""
    text = F.col("message").cast("string")
    broken = (
        F.when(
            (F.col("seq") % 11 == 0) & (F.col("type") == "request"),
            F.regexp_replace(text, "^([A-Z]+) [^\r]*", "$1"),
        )
        .when(F.col("seq") % 11 == 0, F.regexp_replace(text, "^(HTTP/1.1) [0-9]+", "$1 ok"))
        .when((F.col("seq") % 11 == 1) & (F.col("type") == "response"), F.rtrim(text, F.lit("}")))
        .otherwise(text)
    )
    raw = view.rendered_view(spark, sf_dir).withColumn("message", F.encode(broken, "UTF-8"))
    parsed = messages.parse_messages(raw.withColumnRenamed("type", "was"), keep=["was"])
    return messages.malformed(parsed).select("was", F.col("seq").alias("event_id"))


@_query
def refused_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are broken in four ways, and why they are refused."""
    text = F.col("message").cast("string")
    is_request = F.col("type") == "request"
    broken = (
        F.when((F.col("seq") % 11 == 0) & is_request, F.regexp_replace(text, "^([A-Z]+) [^\r]*", "$1"))
        .when(F.col("seq") % 11 == 0, F.regexp_replace(text, "^(HTTP/1.1) [0-9]+", "$1 ok"))
        .when((F.col("seq") % 11 == 1), F.rtrim(text, F.lit("}")))
        .when((F.col("seq") % 11 == 2), F.substring(text, 1, 20))
        .otherwise(text)
    )
    raw = view.rendered_view(spark, sf_dir).withColumn("message", F.encode(broken, "UTF-8"))
    refused = messages.refused_messages(raw.withColumnRenamed("type", "was"), keep=["was"])
    return refused.select("was", F.col("seq").alias("event_id"), "reason")


@_query
def clean_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long bodies with white space of all kinds around them."""
    around = F.concat(F.lit(" \t\n\u000b"), F.col("text"), F.lit("\f\r\n "))
    return view.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(clean_body(around)).alias("digest"), F.length(clean_body(around)).alias("characters")
    )


@_query
def captures_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture folder per node, read together."""
    root = staging_path(spark, "nodes")
    records = staged(view.http_messages_view(spark, sf_dir), "records")
    paths = [f"{root}/node-{n}" for n in range(3)]
    for n, path in enumerate(paths):
        captures.write_captures(records.filter(F.col("node") == f"node-{n}"), path)
    return _record_columns(captures.read_captures(spark, *paths))


@_query
def committed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of three writers in two batches each; a batch comes twice, an attempt is lost before its commit, and the
    second extract takes what was committed since the first."""
    root = staging_path(spark, "committed")
    records = staged(view.http_messages_view(spark, sf_dir).withColumn("half", F.pmod(F.unix_micros("ts"), F.lit(2))), "records")

    def commit(half: int) -> None:
        for n in range(3):
            part = records.filter((F.col("half") == half) & (F.col("node") == f"node-{n}")).drop("half")
            for _ in range(2):
                committed.commit_captures(part, root, half, f"node-{n}")

    lost = records.filter("half = 1").drop("half")
    captures.to_capture_records(lost).write.json(f"{root}/data/node-0/batch=0-lost", compression=captures.COMPRESSION)
    commit(0)
    _, reached = committed.read_new(spark, root, f"{root}/position")
    committed.write_position(reached, f"{root}/position")
    commit(1)
    new, _ = committed.read_new(spark, root, f"{root}/position")
    return _projected(extract.drop_health_checks(new))


@_query
def rejected_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign bytes ahead of every third request are set apart, the messages survive."""
    clean = segments.dedup_segments(view.segments_view(spark, sf_dir))
    event = F.floor(F.col("seq") / 100_000)
    starts = clean.filter(
        (event % 3 == 0) & (F.col("seq") % 100_000 == 0) & F.col("src_ip").startswith("10.244.")
    )
    foreign = starts.withColumn(
        "ts", F.timestamp_micros(F.unix_micros("ts") - 1)
    ).withColumn("payload", F.encode(F.concat(F.lit("~"), event.cast("string"), F.lit("~")), "UTF-8"))
    framed = reassembly.reassemble(clean.unionByName(foreign))
    rejects = reassembly.rejects_only(framed).select(
        "node", "src_ip", "dst_ip", F.col("data").cast("string").alias("bytes")
    )
    return rejects.unionByName(
        reassembly.messages_only(framed)
        .groupBy("node")
        .agg(F.count("*").cast("string").alias("bytes"))
        .select("node", F.lit("").alias("src_ip"), F.lit("").alias("dst_ip"), "bytes")
    )


@_query
def body_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preview of a long value next to its full length."""
    return view.table(spark, sf_dir, "pages").select(
        "page_id", preview(F.col("html")).alias("preview"), F.length("html").alias("characters")
    )


@_query
def service_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of many configuration documents, defaults where a document does not parse."""
    parsed = documents.parse_documents(
        view.config_documents(spark, sf_dir), schemas.SERVICE_CONFIG
    )
    return documents.service_config(parsed).groupBy("has_api_key", "auto_onboard").agg(
        F.count("*").alias("documents"),
        F.sum(F.size("service_mappings")).alias("mappings"),
    )


@_query
def config_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = documents.parse_documents(
        view.config_documents(spark, sf_dir), schemas.SERVICE_CONFIG
    )
    return documents.mappings_of(documents.service_config(parsed))


@_query
def mappings_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "mappings")
    documents.write_mappings(view.mappings_view(spark, sf_dir).drop("origin"), path)
    return documents.read_saved_mappings(spark, path)


@_query
def extract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written report: its endpoint lines, with the total of its metadata document."""
    records = staged(_positioned(spark, sf_dir), "report-input")
    path = staging_path(spark, "report")
    captures.write_extract_report(
        extract.project_extract(extract.drop_health_checks(records)),
        extract.extract_metadata(records),
        path,
    )
    total = (
        spark.read.schema("total_endpoints bigint")
        .json(f"{path}/metadata")
        .select(F.max("total_endpoints"))
        .scalar()
    )
    return (
        spark.read.schema(_REPORT)
        .json(f"{path}/endpoints")
        .withColumn("headers", F.to_json("headers"))
        .withColumn("total_endpoints", total)
    )


# Streams


def _in_order(df: DataFrame, path: str, parts: int) -> int:
    """Store a table as ``parts`` consecutive time ranges of equally many files, a file a core; gives that number.

    The table is computed once, whatever it takes, and its ranges are cut from what was stored."""
    files = max(4, df.sparkSession.sparkContext.defaultParallelism)
    rows = staged(df, "unordered")
    bounds = rows.select(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    width = (bounds[1] - bounds[0]) // parts + 1
    for part in range(parts):
        inside = F.floor((F.unix_micros("ts") - bounds[0]) / width) == part
        rows.filter(inside).repartition(files).write.mode("append").option("compression", "zstd").parquet(path)
    return files


@_query
def stream_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over the stored segments, in three micro-batches."""
    root = staging_path(spark, "segments")
    stored = segments.http_port_filter(view.segments_view(spark, sf_dir)).drop("type")
    files = _in_order(stored, f"{root}/in", parts=3)
    stream = segments.read_segments(spark, f"{root}/in", streaming=True, max_files_per_trigger=files)
    paired = stream_capture.paired_records(
        stream_capture.assemble_stream(stream),
        view.directory_view(spark, sf_dir),
    )
    stream_capture.store_captures(
        messages.to_http_messages(paired), f"{root}/out", f"{root}/checkpoint"
    ).awaitTermination()
    return _paired_columns(captures.read_captures(spark, f"{root}/out"))


@_query
def stream_assemble_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stream on the batch plans, state kept in stored tables."""
    root = staging_path(spark, "assembly")
    stored = segments.http_port_filter(view.segments_view(spark, sf_dir)).drop("type")
    files = _in_order(stored, f"{root}/in", parts=3)
    stream_assembly.start_state(spark, root)
    stream_assembly.assemble_batches(
        segments.read_segments(spark, f"{root}/in", streaming=True, max_files_per_trigger=files),
        root,
        f"{root}/out",
        f"{root}/checkpoint",
        lambda: view.directory_view(spark, sf_dir),
    ).awaitTermination()
    return _paired_columns(captures.read_captures(spark, f"{root}/out"))


@_query
def stream_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfinished and rejected bytes of both streams; the flows resume after a silence, or never."""
    root = staging_path(spark, "leftovers")
    stored = staged(view.broken_off_segments(spark, sf_dir), "broken-off")
    for part in range(1, 4):
        stored.filter(F.col("seq") == part).coalesce(1).write.mode("append").parquet(f"{root}/in")

    def stream() -> DataFrame:
        return segments.read_segments(spark, f"{root}/in", streaming=True, max_files_per_trigger=1)

    stream_assembly.start_state(spark, root)
    stream_assembly.assemble_batches(
        stream(), root, f"{root}/out", f"{root}/batches", lambda: view.directory_view(spark, sf_dir)
    ).awaitTermination()
    columns = ("src_ip", "src_port", _us(), "kind", F.col("data").cast("string").alias("data"))
    batches = stream_assembly.leftovers(spark, root, 2).select(F.lit("batches").alias("plan"), *columns)
    (
        stream_capture.assemble_stream(stream()).withColumnRenamed("message", "data")
        .writeStream.format("parquet")
        .option("path", f"{root}/keyed")
        .option("checkpointLocation", f"{root}/keyed-checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    keyed = spark.read.parquet(f"{root}/keyed").filter("kind <> 'message'").select(F.lit("keyed").alias("plan"), *columns)
    return batches.unionByName(keyed)


@_query
def stream_incremental_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of captures, each followed by an extract of what is new."""
    root = staging_path(spark, "incremental")
    records = staged(view.http_messages_view(spark, sf_dir), "records")
    for half in range(2):
        part = records.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == half)
        captures.write_captures(part, f"{root}/captures")
        stream_extract.extract_new(
            spark, f"{root}/captures", f"{root}/extract", f"{root}/checkpoint"
        ).awaitTermination()
    return spark.read.schema(_REPORT).json(f"{root}/extract").withColumn(
        "headers", F.to_json("headers")
    )


def _catalog_stream(spark: SparkSession, sf_dir: str) -> tuple[stream_catalog_jobs.CatalogTables, int]:
    """Requests in three micro-batches, services onboarded on the way, saved mappings that appear after the first batch;
    gives the tables and their last version."""
    root = staging_path(spark, "catalog")
    requests = view.attributed_requests(spark, sf_dir)
    files = _in_order(requests, f"{root}/in", parts=3)
    listed = catalog.catalog_templates(view.catalog_view(spark, sf_dir)).withColumn(
        "body_example", F.lit(None).cast("string")
    )
    tables = stream_catalog_jobs.CatalogTables(spark, root, compact_every=2)
    tables.start(listed, view.base_mappings(spark, sf_dir))
    stream = (
        spark.readStream.schema(requests.schema)
        .option("maxFilesPerTrigger", files)
        .parquet(f"{root}/in")
    )
    saved = view.saved_mappings(spark, sf_dir)
    stream_catalog_jobs.maintain_catalog(
        stream,
        root,
        f"{root}/checkpoint",
        lambda: view.applications_view(spark, sf_dir),
        auto_onboard=True,
        saved_mappings=lambda number: saved if number > 0 else saved.limit(0),
        compact_every=2,
    ).awaitTermination()
    return tables, tables.last()


@_query
def stream_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, last = _catalog_stream(spark, sf_dir)
    return tables.catalog.read(last)


@_query
def stream_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters and headers of endpoints, kept beside the catalog."""
    tables, last = _catalog_stream(spark, sf_dir)
    return tables.parameters.read(last)


@_query
def stream_onboarding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was planned for each service, once, with the request that started it."""
    tables, last = _catalog_stream(spark, sf_dir)
    return tables.onboarding.read(last)


@_query
def first_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services of a request stream, each once."""
    root = staging_path(spark, "first-requests")
    requests = view.attributed_requests(spark, sf_dir)
    files = _in_order(requests, f"{root}/in", parts=3)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    (
        stream_catalog_jobs.first_requests(stream, delay="60 days")
        .select("service", "type")
        .writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{root}/out")


# Entities


@_query
def list_with_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.list_with_count(view.users_view(spark, sf_dir))


def _asked_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.table(spark, sf_dir, "events").select((F.col("user_id") * 11).alias("user_id"))


@_query
def orders_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.orders_of_users(
        view.users_view(spark, sf_dir),
        view.orders_view(spark, sf_dir),
        _asked_users(spark, sf_dir),
    )


@_query
def unknown_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.unknown_users(view.users_view(spark, sf_dir), _asked_users(spark, sf_dir))


@_query
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.search(
        "RING", view.users_view(spark, sf_dir), view.products_view(spark, sf_dir)
    )


@_query
def search_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.search(
        "R11", view.users_view(spark, sf_dir), view.products_view(spark, sf_dir)
    )


@_query
def sales_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.sales_report(view.orders_view(spark, sf_dir))


@_query
def order_user_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.order_user_details(
        view.orders_view(spark, sf_dir), view.users_view(spark, sf_dir)
    )


@_query
def order_product_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.order_product_info(1, view.products_view(spark, sf_dir))


def _inserted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    fresh = view.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as arrival",
        "case when s_suppkey % 5 <> 0 then s_name end as name",
        "case when s_suppkey % 7 <> 0 then concat('new', cast(s_suppkey as string), '@example.com') end as email",
        "case when s_suppkey % 2 = 0 then 'admin' end as role",
        "cast(null as string) as status",
    )
    return entities.insert_rows(
        view.users_view(spark, sf_dir),
        fresh,
        order="arrival",
        required=("name", "email"),
        defaults={"role": "user", "status": "active"},
    )


@_query
def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inserted(spark, sf_dir)[0]


@_query
def insert_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inserted(spark, sf_dir)[1]


@_query
def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = view.table(spark, sf_dir, "customer").filter("c_custkey % 10 = 1").selectExpr(
        "c_custkey as id",
        "concat(c_name, ' Jr') as fullName",
        "case when c_custkey % 20 = 1 then 'member' end as role",
    )
    return entities.update_rows(view.users_view(spark, sf_dir), changes, {"fullName": "name"})


@_query
def patch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order patches its customer: the last one's status counts, some leave it out, a field of no column is ignored."""
    patches = view.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as id",
        "o_orderkey as arrival",
        "case when o_orderkey % 3 > 0 then concat('after-', cast(o_orderkey as string)) end as status",
        "'x' as nickname",
    )
    return entities.update_rows(view.users_view(spark, sf_dir), patches, order="arrival")


def _deleted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ids = view.table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").selectExpr(
        "c_custkey as id"
    )
    return entities.delete_rows(view.users_view(spark, sf_dir), ids)


@_query
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deleted(spark, sf_dir)[0]


@_query
def deleted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deleted(spark, sf_dir)[1]
