"""The scripted workload of two services, end to end from bytes to inventory."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from apilens import schemas
from apilens.operators import extract
from apilens.operators.inventory import endpoint_inventory
from apilens.operators.messages import correlate, http_records, parse_messages, to_http_messages
from apilens.operators.reassembly import messages_only, reassemble
from apilens.operators.services import address_directory, with_service
from apilens.sources.segments import dedup_segments, http_port_filter

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
API, ORDERS = "example-api", "order-service"

# The calls in order, with the calls they cause (service, method, path, status).
CALLS = [
    (API, "GET", "/", 200), (API, "GET", "/api/v1/users", 200),
    (API, "GET", "/api/v1/users/1", 200), (API, "GET", "/api/v1/users/2", 200),
    (API, "POST", "/api/v1/users", 201), (API, "PUT", "/api/v1/users/1", 200),
    (API, "PATCH", "/api/v1/users/2", 200), (API, "GET", "/api/v1/users/1/orders", 200),
    (API, "GET", "/api/v1/products", 200), (API, "GET", "/api/v1/products/1", 200),
    (API, "POST", "/api/v1/products", 201), (API, "GET", "/api/v1/search?q=Alice", 200),
    (API, "DELETE", "/api/v1/users/3", 200),
    (ORDERS, "GET", "/", 200), (ORDERS, "GET", "/api/v2/orders", 200),
    (ORDERS, "GET", "/api/v2/orders/1", 200), (ORDERS, "GET", "/api/v2/orders/2", 200),
    (ORDERS, "POST", "/api/v2/orders", 201), (ORDERS, "PUT", "/api/v2/orders/1", 200),
    (ORDERS, "GET", "/api/v2/inventory", 200), (ORDERS, "GET", "/api/v2/inventory/1", 200),
    (ORDERS, "POST", "/api/v2/inventory", 201), (ORDERS, "GET", "/api/v2/reports/sales", 200),
    (ORDERS, "DELETE", "/api/v2/orders/3", 200),
    (API, "GET", "/api/v1/orders/1", 200), (ORDERS, "GET", "/api/v2/orders/1", 200),
    (API, "GET", "/api/v1/orders/2", 200), (ORDERS, "GET", "/api/v2/orders/2", 200),
    (API, "GET", "/api/v1/inventory/summary", 200), (ORDERS, "GET", "/api/v2/inventory", 200),
    (ORDERS, "GET", "/api/v2/orders/1/user-details", 200),
    (API, "GET", "/api/v1/search?q=John", 200),
    (ORDERS, "GET", "/api/v2/orders/2/user-details", 200),
    (API, "GET", "/api/v1/search?q=Jane", 200),
    (ORDERS, "GET", "/api/v2/orders/1/product-info", 200), (API, "GET", "/api/v1/products", 200),
]


def captured_segments():
    rows = []
    for i, (service, method, path, status) in enumerate(CALLS):
        client, server = ("10.244.0.9", 40000 + i), ("10.96.0.1" if service == API else "10.96.0.2", 80)
        body = b'{"name": "J\xc3\xb6"}' if method in ("POST", "PUT", "PATCH") else b""
        length = b"Content-Length: %d\r\n" % len(body) if body else b""
        request = f"{method} {path} HTTP/1.1\r\nHost: {service}\r\n".encode() + length + b"\r\n" + body
        answer = b'{"ok": true}'
        response = b"HTTP/1.1 %d OK\r\nContent-Length: %d\r\n\r\n" % (status, len(answer)) + answer
        for delay, data, (a, b) in ((0, request, (client, server)), (30, response, (server, client))):
            cut = len(data) // 3
            for k, piece in enumerate((data[:cut], data[cut:])):
                ts = START + timedelta(seconds=i, milliseconds=delay + k)
                for iface in ("eth0", "veth1"):
                    rows.append((ts, "n1", iface, *a, *b, k, piece))
                    ts += timedelta(microseconds=20)
    return rows


@pytest.fixture(scope="module")
def records(spark):
    segments = http_port_filter(spark.createDataFrame(captured_segments(), schemas.SEGMENTS))
    parsed = http_records(parse_messages(messages_only(reassemble(dedup_segments(segments)))))
    directory = address_directory(
        spark.createDataFrame([], schemas.PODS), spark.createDataFrame([], schemas.K8S_SERVICES)
    )
    return to_http_messages(correlate(with_service(parsed, directory))).cache()


def test_totals(records):
    def counted(df):
        return {r[0]: r["records"] for r in df.collect()}

    assert counted(extract.summary_by_type(records)) == {"request": 36, "response": 36}
    assert counted(extract.summary_by_method(records)) == {
        "GET": 27, "POST": 4, "PUT": 2, "PATCH": 1, "DELETE": 2,
    }
    assert counted(extract.summary_by_status(records)) == {200: 32, 201: 4}
    onepass = {(r.summary, r.value): r.records for r in extract.summary_onepass(records).collect()}
    assert onepass[("type", "request")] == 36 and onepass[("status", "201")] == 4
    assert onepass[("method", "GET")] == 27 and len(onepass) == 2 + 5 + 2


def test_unique_endpoints_and_health(records):
    # Both services answer "/": 32 pairs per service, 31 without the service.
    assert extract.unique_endpoints(records).count() == 31
    assert extract.drop_health_checks(records).count() == 72


def test_inventory(records):
    rows = endpoint_inventory(records.filter("type = 'request'")).collect()
    assert len(rows) == 26
    assert sum(r.service == API for r in rows) == 14
    hits = {(r.service, r.method, r.template): (r.hits, r.raw_paths) for r in rows}
    assert hits[(API, "GET", "/api/v1/users/{id}")] == (2, 2)
    assert hits[(API, "GET", "/api/v1/search")] == (3, 3)
    assert hits[(ORDERS, "GET", "/api/v2/orders/{id}")] == (4, 2)
    assert hits[(ORDERS, "GET", "/api/v2/orders/{id}/user-details")] == (2, 2)


def test_responses_belong_to_their_requests(records):
    got = sorted(
        (r.ts, r.service, r.method, r.endpoint, r.status_code)
        for r in records.filter("type = 'response'").collect()
    )
    assert [row[1:] for row in got] == CALLS


def test_bodies_and_ids(records):
    assert records.filter("request_body = '{\"name\": \"Jö\"}'").count() == 7
    assert records.select("id").distinct().count() == 72
    assert records.schema.simpleString() == records.sparkSession.createDataFrame(
        [], schemas.HTTP_MESSAGES
    ).schema.simpleString()


PAIRING = (
    "node string, ts timestamp, seq bigint, n int, type string, method string, endpoint string, "
    "host string, service string, source_ip string, source_port int, destination_ip string, "
    "destination_port int"
)


def message(ms, kind, client=1, **fields):
    row = {
        "node": "n", "ts": START + timedelta(milliseconds=ms), "seq": 0, "n": 0, "type": kind,
        "method": None, "endpoint": None, "host": None, "service": "unknown", **fields,
    }
    ends = ("10.0.0.1", client, "10.0.0.2", 80)
    if kind == "response":
        ends = ends[2:] + ends[:2]
    return {**row, **dict(zip(
        ("source_ip", "source_port", "destination_ip", "destination_port"), ends, strict=True))}


@pytest.mark.parametrize("chunk_seconds", [1, 60])
def test_pairing_rules(spark, chunk_seconds):
    asked = {"method": "GET", "endpoint": "/a", "host": "svc", "service": "svc"}
    rows = [
        message(0, "response"),
        message(1000, "request", **asked),
        message(1000, "response"),
        message(9000, "response"),
        message(9500, "response", client=2),
        message(9600, "request", **{**asked, "endpoint": "/b"}),
        message(25000, "response"),
    ]
    df = spark.createDataFrame(
        [tuple(r[c.split()[0]] for c in PAIRING.split(", ")) for r in rows], PAIRING
    )
    got = correlate(df, chunk_seconds).filter("type = 'response'").orderBy("ts").collect()
    assert [(r.method, r.endpoint, r.host, r.service) for r in got] == [
        ("UNKNOWN", "/", "10.0.0.1", "unknown"),
        ("GET", "/a", "svc", "svc"),
        ("GET", "/a", "svc", "svc"),
        ("UNKNOWN", "/", "10.0.0.1", "unknown"),
        ("GET", "/b", "svc", "svc"),
    ]


def test_pairing_equals_one_pass(spark):
    """Random traffic, most of it on one connection, against a loop over the records in order."""
    rng = random.Random(11)
    rows = []
    for number in range(1500):
        client = 1 if rng.random() < 0.6 else rng.randint(2, 40)
        kind = rng.choice(["request", "response", "response"])
        fields = {"method": "GET", "endpoint": f"/{number}", "host": "h", "service": "s"}
        row = message(rng.randint(0, 400_000), kind, client, **(fields if kind == "request" else {}))
        rows.append({**row, "seq": number})
    names = [part.split()[0] for part in PAIRING.split(", ")]
    got = correlate(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PAIRING), 7)
    want, latest = {}, {}
    for row in sorted(rows, key=lambda r: (r["ts"], r["type"], r["seq"])):
        if row["type"] == "request":
            latest[row["source_port"]] = row["endpoint"]
        else:
            want[row["seq"]] = latest.get(row["destination_port"], "/")
    assert {r.seq: r.endpoint for r in got.filter("type = 'response'").collect()} == want


def test_metadata_of_nothing(records):
    row = extract.extract_metadata(
        records.withColumn("position", F.lit(1)).filter("false"), last_position=7
    ).first()
    assert (row.total_endpoints, row.node, row.new_only) == (0, "unknown", True)
