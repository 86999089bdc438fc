"""Column functions on small rows."""

import pytest
from pyspark.sql import functions as F

from apilens.functions import http, paths
from apilens.functions.hosts import (
    host_label,
    is_cluster_traffic,
    is_inter_service,
    names_no_service,
)
from apilens.functions.values import clean_body, decode_ignore, decode_replace, preview
from apilens.operators.extract import is_health_check

C = F.col


def values(spark, inputs, make):
    """Evaluate ``make`` on each input, in order."""
    kind = "binary" if isinstance(next(i for i in inputs if i is not None), bytes) else "string"
    df = spark.createDataFrame(list(enumerate(inputs)), f"at int, x {kind}")
    return [r[0] for r in df.orderBy("at").select(make(C("x"))).collect()]


UUID = "0a1b2c3d-4e5f-6071-8293-a4b5c6d7e8f9"


def test_path_template(spark):
    cases = {
        "/api/v1/users/1": "/api/v1/users/{id}",
        f"/api/v1/users/{UUID}": "/api/v1/users/{id}",
        f"/api/v1/users/{UUID.upper()}": "/api/v1/users/{id}",
        "/api/v1/users/1/orders/2": "/api/v1/users/{id}/orders/{id}",
        "/api/v1/users/{id}": "/api/v1/users/{id}",
        "/": "/",
        "": "",
        "/?q=1": "/",
        "//7//": "//{id}//",
        "/v1/12a": "/v1/12a",
        "/:x/@y": "/:x/@y",
        "/a/7?b=8/9": "/a/{id}",
        "/a/7#frag": "/a/7#frag",
        f"/{UUID}0": f"/{UUID}0",
        "/٣": "/٣",
    }
    assert values(spark, list(cases), paths.path_template) == list(cases.values())


def test_endpoint_id_has_one_line(spark):
    import base64

    path = "/api/" + "x" * 200
    (made,) = values(spark, [path], lambda c: paths.endpoint_id(F.lit("get"), c))
    assert made == base64.b64encode(f"GET:{path}".encode()).decode()


def test_catalog_key_and_norm_path(spark):
    keys = values(spark, ["a/b", "/a"], lambda c: paths.catalog_key(F.lit("PUT"), c))
    assert keys == ["put:/a/b", "put:/a"]


def test_query_params(spark):
    rows = values(
        spark, ["/p", "/p?", "/p?a=1&b=x%20y&c&a=2&d=%zz&e=f=g"], paths.query_params
    )
    assert rows[0] == [] and rows[1] == []
    assert [tuple(r) for r in rows[2]] == [
        ("a", "1"), ("b", "x y"), ("c", ""), ("a", "2"), ("d", "%zz"), ("e", "f=g"),
    ]


def test_path_params(spark):
    rows = values(
        spark,
        ["/u/7/o/8?x=1"],
        lambda c: paths.path_params(F.lit("/u/{id}/@kind/:oid"), c),
    )
    assert [tuple(r) for r in rows[0]] == [("id", "7"), ("kind", "o"), ("oid", "8")]


def test_names_no_service(spark):
    addresses = ["10.1.2.3:80", "10", "07", "0x7f", "0", "4294967295", "0x00ffffffff",
                 "037777777777", "", None]
    names = ["08", "12a", "a.b.c", "0x", "4294967296", "0x1ffffffff", "047777777777", "x10"]
    assert all(values(spark, addresses, names_no_service))
    assert not any(values(spark, names, names_no_service))


def test_host_label(spark):
    hosts = ["a.b.c", "svc:80", "svc.ns.svc.cluster.local:80", ".x"]
    assert values(spark, hosts, host_label) == ["a", "svc", "svc", ""]


def test_address_predicates(spark):
    inside = values(
        spark, ["10.244.1.1", "10.96.0.1", "10.2440.1.1", "10.9.6.1"],
        lambda c: is_cluster_traffic(c, F.lit("1.1.1.1")),
    )
    assert inside == [True, True, False, False]
    hosts = ["1.1.1.1", "a.b", "a.b.c", "a.svc.cluster.local", "svc", "x.svc.cluster.local"]
    assert values(spark, hosts, lambda c: is_inter_service(c, F.lit("1.1.1.1"))) == [
        False, False, True, True, False, True,
    ]


def test_health_checks(spark):
    dropped = ["/health", "/health/x", "/health?x", "/HEALTH", "/status", "/ping/"]
    kept = ["/healthy", "/api/health", "/HEALTH/x", "/", "/statusx", "/health\n"]
    assert all(values(spark, dropped, is_health_check))
    assert not any(values(spark, kept, is_health_check))


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("GET /a HTTP/1.0", ("GET", "/a", "HTTP/1.0")),
        ("GETX / HTTP/1.1", ("GETX", "/", "HTTP/1.1")),
        ("GET /a", ("GET", "/a", "HTTP/1.1")),
        ("GET\t/a  HTTP/1.1 junk", ("GET", "/a", "HTTP/1.1")),
        ("GET", None),
        ("GET \t", None),
    ],
)
def test_request_line(spark, line, expected):
    (got,) = values(spark, [line], http.request_line)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("HTTP/1.1 200 OK", ("HTTP/1.1", 200, "OK")),
        ("HTTP/1.1 404 Not  Found", ("HTTP/1.1", 404, "Not  Found")),
        ("HTTP/1.1 204", ("HTTP/1.1", 204, "")),
        ("HTTP/1.1 abc", None),
        ("HTTP/1.1", None),
    ],
)
def test_status_line(spark, line, expected):
    (got,) = values(spark, [line], http.status_line)
    assert (tuple(got) if got else None) == expected


def test_headers(spark):
    head = "GET / HTTP/1.1\r\nHost: a\r\nX: 1\r\nno colon\r\nX:\t2 \r\nurl: http://x:1/\r\nx: 3\r\nEmpty:"
    (got,) = values(spark, [head], lambda c: http.header_map(http.header_pairs(c)))
    assert got == {"Host": "a", "X": "2", "url": "http://x:1/", "x": "3", "Empty": ""}
    assert values(spark, ["GET / HTTP/1.1"], lambda c: http.header_map(http.header_pairs(c))) == [{}]


def test_content_length(spark):
    heads = [
        "POST / HTTP/1.1\r\ncontent-LENGTH : 12 \r\nContent-Length: 5",
        "POST / HTTP/1.1\r\nContent-Length: x\r\nContent-Length: 7",
        "POST / HTTP/1.1\r\nContent-Length: -4",
        "POST / HTTP/1.1\r\nContent-Length: +4",
        "POST / HTTP/1.1\r\nX-Content-Length: 4",
        "POST / HTTP/1.1\r\nContent-Length: 0000000000000000003",
        "POST / HTTP/1.1\r\nContent-Length: 9999999999999999999",
        "POST / HTTP/1.1\r\nX: a\rContent-Length: 5",
        "Content-Length: 5 HTTP/1.1\r\nHost: a",
        "POST / HTTP/1.1\r\nContent-Length: 000\r\nHost: a",
    ]
    huge = http.UNREACHABLE_LENGTH
    assert values(spark, heads, http.content_length) == [
        12, 7, None, None, None, 3, huge, None, None, 0,
    ]


def test_completeness(spark):
    messages = [
        b"GET / HTTP/1.1\r\n",
        b"GET / HTTP/1.1\r\n\r\n",
        b"POST / HTTP/1.1\r\nContent-Length: 3\r\n\r\nab",
        b"POST / HTTP/1.1\r\nContent-Length: 3\r\n\r\nabc",
        b"POST / HTTP/1.1\r\nContent-Length: 4\r\n\r\n\xc3\xa9\xff\xfe",
    ]
    assert values(spark, messages, http.is_complete) == [False, True, False, True, True]


def test_body_length_rule(spark):
    ok = values(
        spark, [b"abc", b"ab"], lambda c: http.body_length_ok(F.lit("POST"), c, F.lit(3))
    )
    assert ok == [True, False]


def test_decoding(spark):
    data = [b"ok", b"a\xffb", b"caf\xc3", "é".encode()]
    assert values(spark, data, decode_replace) == [d.decode("utf-8", "replace") for d in data]
    assert values(spark, data, decode_ignore) == [d.decode("utf-8", "ignore") for d in data]


def test_body_helpers(spark):
    assert values(spark, [" \r\n{a} \n\n", None], clean_body) == ["{a}", None]
    assert values(spark, ["x" * 300], preview) == ["x" * 200]
