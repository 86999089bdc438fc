"""HTTP traffic derived from the test tables.

The tables hold no HTTP traffic, so every row of ``events`` becomes one request and, for most of
them, one response; mappings, catalog, applications, pods and entities come from ``customer``,
``supplier``, ``orders`` and ``part``. ``apilens.plans.oracles`` states the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apilens.functions.values import big_endian_bytes, utc_instant
from apilens.operators.catalog import INSTANCE, explode_catalog
from apilens.operators.messages import correlate, to_http_messages
from apilens.operators.onboarding import flatten_applications
from apilens.operators.services import (
    address_directory,
    overlay_mappings,
    usable_mappings,
    with_service,
)
from apilens.sources.documents import parse_application_listings, parse_catalog_listings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(expression: str) -> str:
    return f"cast({expression} as string)"


def requests_view(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """One captured request per event. ``spread`` deals the narrow events to all tasks, for views that make much of them;
    a table stored in few row groups would be few tasks' work."""
    event = table(spark, sf_dir, "events").select(
        "event_id", utc_instant(F.col("ts")).alias("ts"), "user_id", "event_type", "props"
    )
    if spread:
        event = event.repartition("event_id")
    uuid = "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))"
    return event.selectExpr(
        "*",
        f"md5({_text('user_id')}) as h",
        "concat('10.96.0.', cast(1 + event_id % 4 as string)) as destination_ip",
    ).selectExpr(
        "event_id",
        "ts",
        f"concat('node-', {_text('event_id % 3')}) as node",
        "case event_id % 7 when 0 then 'lo' when 1 then 'eth0' when 2 then 'veth1' "
        "when 3 then 'cni0' else 'wlan0' end as iface",
        f"concat('10.244.', {_text('user_id % 4')}, '.', {_text('user_id % 250')}) as source_ip",
        "cast(1024 + user_id % 60000 as int) as source_port",
        "destination_ip",
        "cast(case event_id % 8 when 0 then 443 when 1 then 22 when 2 then 8080 when 3 then 9000 "
        "else 80 end as int) as destination_port",
        "case user_id % 6 when 0 then 'example-api' when 1 then 'order-service:80' "
        "when 2 then 'order-service.default.svc.cluster.local' "
        f"when 3 then concat('svc-', {_text('user_id')}, '.prod') "
        "when 4 then destination_ip end as host_header",
        "case event_type when 'signup' then 'POST' when 'purchase' then 'PUT' "
        "when 'error' then 'DELETE' else 'GET' end as method",
        "case when event_id % 20 = 0 then '/healthz' when event_id % 20 = 1 then '/status?full=1' "
        f"when event_type = 'view' then concat('/api/v1/users/', {_text('user_id')}) "
        f"when event_type = 'click' then concat('/api/v1/users/', {_text('user_id')}, '/orders/', "
        f"{_text('event_id % 100')}, '?k=', {_text('event_id % 10')}) "
        "when event_type = 'signup' then '/api/v1/users' "
        f"when event_type = 'purchase' then concat('/api/v2/orders/', {uuid}) "
        f"else concat('/api/v1/products/', {_text('user_id % 40')}) end as endpoint",
        "case when event_type in ('signup', 'purchase') then props else '' end as request_body",
        "case event_type when 'signup' then 201 when 'error' then 404 else 200 end as status_code",
        "event_id % 10 <> 9 as has_response",
        "event_id % 97 = 5 as lost",
    )


def messages_view(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Parsed requests and responses as they leave the parser: not attributed, not paired."""
    view = requests_view(spark, sf_dir, spread).withColumn(
        "response_body", F.expr("concat('{\"event\": ', cast(event_id as string), ', \"note\": \"é\"}')")
    )
    host = F.coalesce("host_header", "destination_ip")

    def headers(body: str, with_host: bool):
        pairs = [("Content-Type", F.lit("application/json")),
                 ("Content-Length", F.octet_length(body).cast("string"))]
        if with_host:
            pairs.insert(0, ("Host", F.col("host_header")))
        made = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
        return F.map_from_entries(F.filter(made, lambda p: p["value"].isNotNull()))

    null = F.lit(None).cast("string")
    request = F.struct(
        F.lit("request").alias("type"),
        (F.col("event_id") * 2).alias("position"),
        F.col("ts").alias("ts"),
        F.col("source_ip").alias("source_ip"),
        F.col("source_port").alias("source_port"),
        F.col("destination_ip").alias("destination_ip"),
        F.col("destination_port").alias("destination_port"),
        F.col("method").alias("method"),
        F.col("endpoint").alias("endpoint"),
        host.alias("host"),
        F.lit(None).cast("int").alias("status_code"),
        null.alias("status_text"),
        headers("request_body", True).alias("headers"),
        F.col("request_body").alias("body"),
    )
    response = F.struct(
        F.lit("response").alias("type"),
        (F.col("event_id") * 2 + 1).alias("position"),
        (F.col("ts") + F.expr("interval 5 milliseconds")).alias("ts"),
        F.col("destination_ip").alias("source_ip"),
        F.col("destination_port").alias("source_port"),
        F.col("source_ip").alias("destination_ip"),
        F.col("source_port").alias("destination_port"),
        null.alias("method"),
        null.alias("endpoint"),
        null.alias("host"),
        F.col("status_code").alias("status_code"),
        F.expr("case status_code when 201 then 'CREATED' when 404 then 'NOT FOUND' else 'OK' end")
        .alias("status_text"),
        headers("response_body", False).alias("headers"),
        F.col("response_body").alias("body"),
    )
    both = F.filter(
        F.array(F.when(~F.col("lost"), request), F.when(F.col("has_response"), response)),
        lambda m: m.isNotNull(),
    )
    return view.select("node", F.col("event_id").alias("seq"), F.inline(both)).select(
        "node",
        "source_ip",
        "source_port",
        "destination_ip",
        "destination_port",
        "ts",
        "seq",
        F.lit(0).alias("n"),
        "position",
        "type",
        "method",
        "endpoint",
        "host",
        "status_code",
        "status_text",
        F.lit("HTTP/1.1").alias("version"),
        "headers",
        "body",
    )


def pods_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('10.96.', cast(s_suppkey div 200 as string), '.', cast(1 + s_suppkey % 200 as string)) as ip",
        "'default' as namespace",
        "concat('pod-', cast(s_suppkey as string)) as name",
        "case s_suppkey % 4 when 0 then map('app', concat('gw-', cast(s_suppkey as string))) "
        "when 1 then map('tier', 'x', 'service', concat('node-', cast(s_suppkey as string))) "
        "when 2 then map('tier', 'x') else map('app', '') end as labels",
    )


def k8s_services_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").filter("s_suppkey % 4 in (0, 2)").selectExpr(
        "concat('10.96.', cast(s_suppkey div 200 as string), '.', cast(1 + s_suppkey % 200 as string)) as cluster_ip",
        "'default' as namespace",
        "concat('kube-', cast(s_suppkey as string)) as name",
    )


def directory_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address_directory(pods_view(spark, sf_dir), k8s_services_view(spark, sf_dir))


def attributed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a service."""
    return with_service(messages_view(spark, sf_dir), directory_view(spark, sf_dir))


def attributed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests only, as canonical records; needs no pairing."""
    requests = attributed_view(spark, sf_dir).filter("type = 'request'")
    return to_http_messages(requests)


def http_messages_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records of requests and paired responses."""
    return to_http_messages(correlate(attributed_view(spark, sf_dir)))


def base_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 4").selectExpr(
        "case c_custkey when 0 then 'example-api' when 1 then 'order-service' "
        "else concat('svc-', cast(c_custkey as string)) end as service",
        "concat('app-', cast(c_custkey as string)) as appId",
        "case when c_custkey % 7 = 3 then '' else concat('inst-', cast(c_custkey as string)) end as instanceId",
    )


def saved_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").filter("s_suppkey % 4 in (0, 1)").selectExpr(
        "case s_suppkey when 0 then 'order-service' "
        "else concat('svc-', cast(s_suppkey * 3 as string)) end as service",
        "concat('app-s', cast(s_suppkey as string)) as appId",
        "case when s_suppkey % 9 = 8 then '' else concat('inst-s', cast(s_suppkey as string)) end as instanceId",
    )


def mappings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay_mappings(base_mappings(spark, sf_dir), saved_mappings(spark, sf_dir))


def catalog_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing document per mapped instance."""
    number = F.regexp_extract("appId", "([0-9]+)", 1)
    document = F.format_string(
        '{"endpointGroups":[{"endpoints":['
        '{"method":"GET","path":"/api/v1/users/{id}","id":"%2$s"},'
        '{"method":"get","path":"api/v1/users/{uid}/orders/{oid}","id":"e2-%1$s"}]},'
        '{"endpoints":['
        '{"method":"POST","path":"/api/v1/users","id":"e3-%1$s"},'
        '{"method":"PUT","path":"/api/v2/orders/:oid","id":"e4-%1$s"},'
        '{"method":"DELETE","path":"/api/v1/products/7","id":"e5-%1$s"},'
        '{"method":"POST","path":"/api/v1/users","id":"e6-%1$s"},'
        '{"method":"","path":"/x","id":"e7-%1$s"},'
        '{"method":"GET","path":"/healthz","id":"e8-%1$s"}]}]}',
        number,
        F.when(number.cast("int") % 3 == 1, "").otherwise(F.concat(F.lit("e1-"), number)),
    )
    return usable_mappings(mappings_view(spark, sf_dir)).select(
        *INSTANCE, document.alias("document")
    )


def catalog_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_catalog(parse_catalog_listings(catalog_documents(spark, sf_dir)))


def applications_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application x instance rows of one listing document per customer."""
    key = "cast(c_custkey as string)"
    documents = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as listing",
        f"""concat(
            '{{"applications":[{{"applicationId":"a-', {key}, '","applicationName":"svc-', {key},
            '","instances":[',
            case c_custkey % 4 when 1 then ''
                 when 3 then concat('{{"instanceId":"i-', {key}, '-0","instanceName":"one"}}')
                 else concat('{{"instanceId":"i-', {key}, '-0","instanceName":"one"}},',
                             '{{"instanceId":"i-', {key}, '-1","instanceName":"two"}}') end,
            ']}},{{"applicationId":"b-', {key}, '","applicationName":"svc-',
            cast(c_custkey div 3 * 3 as string), '","instances":[{{"instanceId":"j-', {key},
            '","instanceName":"one"}}]}},{{"applicationId":"c-', {key},
            '","applicationName":"Svc-', {key}, '","instances":[]}}],"nextToken":null}}'
        ) as document""",
    )
    return flatten_applications(parse_application_listings(documents))


def rendered_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as HTTP/1.1 bytes."""
    head = F.expr(
        "case when type = 'request' then concat(method, ' ', endpoint, ' HTTP/1.1') "
        "else concat('HTTP/1.1 ', cast(status_code as string), ' ', status_text) end"
    )
    lines = F.transform(
        F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    )
    text = F.concat(
        head, F.lit("\r\n"), F.array_join(lines, "\r\n"), F.lit("\r\n\r\n"), F.col("body")
    )
    return messages_view(spark, sf_dir, spread=True).select(
        "node",
        F.col("source_ip").alias("src_ip"),
        F.col("source_port").alias("src_port"),
        F.col("destination_ip").alias("dst_ip"),
        F.col("destination_port").alias("dst_port"),
        "ts",
        "seq",
        "n",
        "type",
        F.encode(text, "UTF-8").alias("message"),
    )


def segments_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered messages cut into 1 to 3 segments; every fourth is seen on a second interface."""
    pieces = F.col("seq") % 3 + 1
    size = F.ceil(F.length("message") / pieces)
    cut = rendered_view(spark, sf_dir).select(
        "*", size.alias("size"), F.explode(F.sequence(F.lit(0), (pieces - 1).cast("int"))).alias("at")
    )
    copies = F.when(F.col("seq") % 4 == 0, F.array(F.lit("eth0"), F.lit("veth1"))).otherwise(
        F.array(F.lit("eth0"))
    )
    shown = cut.select("*", F.explode(copies).alias("iface"))
    late = F.when(F.col("iface") == "veth1", 3).otherwise(0)
    return shown.select(
        F.timestamp_micros(F.unix_micros("ts") + F.col("at") + late).alias("ts"),
        "node",
        "iface",
        "src_ip",
        "src_port",
        "dst_ip",
        "dst_port",
        (F.col("seq") * 100_000 + F.col("at") * F.col("size")).alias("seq"),
        F.substring(
            "message", (F.col("at") * F.col("size") + 1).cast("int"), F.col("size").cast("int")
        ).alias("payload"),
        "type",
    )


def long_download_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 10,000 events are an hour of two downloads, an event a segment; every ninth is seen twice.

    A head with the length of the whole body comes first; a short answer and the first bytes of a head come last.
    """
    piece = "concat(cast(event_id as string), ':', props, ';')"
    event = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "event_id div 10000 as hour",
        "cast(8000 + event_id % 2 as int) as src_port",
        f"{piece} as piece",
        "1704067200000000 + (event_id div 10000) * 7200000000 + (event_id % 10000) * 360000 as us",
    )
    heads = event.groupBy("hour", "src_port").agg(
        F.sum(F.octet_length("piece")).alias("size"), F.min("us").alias("first"), F.max("us").alias("last")
    )
    text = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    around = heads.select(
        "hour",
        "src_port",
        F.inline(
            F.array(
                F.struct((F.col("first") - 1000).alias("us"), F.lit(-2).cast("bigint").alias("seq"), text.alias("piece")),
                F.struct(
                    (F.col("last") + 1000).alias("us"),
                    F.lit(-1).cast("bigint").alias("seq"),
                    F.lit("HTTP/1.1 204 No Content\r\nContent-Length: 0\r\n\r\nHTTP/1.1 20").alias("piece"),
                ),
            )
        ),
    )
    copies = F.when(F.col("event_id") % 9 == 0, F.array(F.lit(0), F.lit(5000))).otherwise(F.array(F.lit(0)))
    body = event.select("hour", "src_port", "us", F.col("event_id").alias("seq"), "piece", F.explode(copies).alias("late"))
    return body.withColumn("us", F.col("us") + F.col("late")).drop("late").unionByName(around).select(
        F.timestamp_micros("us").alias("ts"),
        F.lit("node-0").alias("node"),
        F.lit("eth0").alias("iface"),
        F.concat(F.lit("10.96.1."), F.col("hour").cast("string")).alias("src_ip"),
        "src_port",
        F.lit("10.244.0.1").alias("dst_ip"),
        F.lit(50000).alias("dst_port"),
        "seq",
        F.encode("piece", "UTF-8").alias("payload"),
    )


def broken_off_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow per user: half a request that counts the user's events; after a silence foreign bytes and a whole request,
    but only if the user's number is no multiple of three. Much later one last flow."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("events"), F.sum("event_id").alias("total")
    )
    parts = users.selectExpr(
        "user_id",
        "inline(filter(array("
        "struct(1 as part, user_id % 60 as second, concat('POST /half HTTP/1.1\r\nContent-Length: 1000\r\n\r\n', "
        "cast(events as string), ';') as text),"
        "struct(2 as part, 700 + user_id % 60 as second, concat('~', cast(total as string), '~GET /whole HTTP/1.1\r\n\r\n') as text)),"
        " p -> p.part = 1 or user_id % 3 > 0))",
    )
    last = spark.range(1).selectExpr("-1L as user_id", "3 as part", "5000L as second", "'GET /last HTTP/1.1\r\n\r\n' as text")
    return parts.unionByName(last).select(
        F.timestamp_micros(F.lit(1704067200000000) + F.col("second") * 1_000_000).alias("ts"),
        F.lit("node-0").alias("node"),
        F.lit("eth0").alias("iface"),
        F.concat(F.lit("10.244.9."), F.col("user_id").cast("string")).alias("src_ip"),
        F.when(F.col("user_id") % 2 == 0, F.lit(4000)).alias("src_port"),
        F.lit("10.96.0.1").alias("dst_ip"),
        F.lit(80).alias("dst_port"),
        F.col("part").cast("bigint").alias("seq"),
        F.encode("text", "UTF-8").alias("payload"),
    )


def packets_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments as IPv4/TCP packets, every seventh with TCP options, some UDP between."""
    def address(column: str):
        return F.concat(*[big_endian_bytes(F.split(column, r"\.")[i], 1) for i in range(4)])

    event = F.floor(F.col("seq") / 100_000)
    options = F.when(event % 7 == 0, F.unhex(F.lit("01010101"))).otherwise(F.unhex(F.lit("")))
    packet = F.concat(
        F.unhex(F.lit("4500")),
        big_endian_bytes(F.length("payload") + 40, 2),
        F.unhex(F.lit("0000000040")),
        F.when(event % 50 == 3, F.unhex(F.lit("11"))).otherwise(F.unhex(F.lit("06"))),
        F.unhex(F.lit("0000")),
        address("src_ip"),
        address("dst_ip"),
        big_endian_bytes(F.col("src_port"), 2),
        big_endian_bytes(F.col("dst_port"), 2),
        big_endian_bytes(F.col("seq") % (1 << 32), 4),
        F.unhex(F.lit("00000000")),
        F.when(event % 7 == 0, F.unhex(F.lit("60"))).otherwise(F.unhex(F.lit("50"))),
        F.unhex(F.lit("18FFFF00000000")),
        options,
        F.col("payload"),
    )
    return segments_view(spark, sf_dir).select("ts", "node", "iface", packet.alias("packet"))


def config_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One service configuration text per customer; every eighth is not JSON."""
    key = "cast(c_custkey as string)"
    return table(spark, sf_dir, "customer").selectExpr(
        f"""case when c_custkey % 8 = 7 then '{{"apiKey": oops' else concat(
            '{{"apiKey": "', if(c_custkey % 3 = 0, ' ', 'key'), '", ',
            if(c_custkey % 2 = 0, '"autoOnboardNewServices": true, ', ''),
            '"serviceMappings": {{"svc-', {key}, '": {{"appId": "app-', {key},
            '", "instanceId": "inst-', {key}, '"}}, "alias-', {key}, '": {{"appId": "app-', {key},
            '"}}}}}}') end as value"""
    )


def users_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id",
        "c_name as name",
        "concat('user', cast(c_custkey as string), '@example.com') as email",
        "lower(c_mktsegment) as role",
        "case when c_acctbal < 0 then 'inactive' else 'active' end as status",
    )


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id",
        "o_custkey as user_id",
        "o_totalprice as total",
        "case o_orderstatus when 'P' then 'pending' when 'F' then 'completed' else 'processing' end as status",
        "case o_orderkey % 10 when 0 then concat('User', cast(o_custkey as string), '@ex Corp') "
        "when 1 then '' when 2 then 'Nobody Else' "
        "else concat(substr(concat('Customer#', lpad(cast(o_custkey as string), 9, '0')), 1, 17), ' Ltd') "
        "end as customer",
    )


def products_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as id", "p_name as name", "p_retailprice as price", "p_size as stock"
    )
