"""Matching, decisions, upsert and onboarding against direct computation."""

import json
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from apilens import schemas
from apilens.operators import catalog, onboarding, payloads, services
from apilens.sources.documents import parse_application_listings, parse_catalog_listings

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
REQUESTS = (
    "id string, ts timestamp, method string, endpoint string, request_body string, "
    "request_headers map<string,string>, appId string, instanceId string"
)


def requests(spark, rows):
    return spark.createDataFrame(
        [(str(i), START + timedelta(seconds=i), m, e, b, h, "a", "i")
         for i, (m, e, b, h) in enumerate(rows)],
        REQUESTS,
    )


def templates(spark, rows):
    return spark.createDataFrame(
        [("a", "i", m, p, e) for m, p, e in rows],
        "appId string, instanceId string, method string, path string, endpoint_id string",
    )


def marked(part):
    return (part.startswith("{") and part.endswith("}")) or part[:1] in (":", "@")


def best_template(path, known):
    parts = path.split("/")
    fits = [
        t for t in known
        if len(t.split("/")) == len(parts)
        and all(marked(a) or a == b for a, b in zip(t.split("/"), parts, strict=True))
    ]
    return min(fits, key=lambda t: (sum(map(marked, t.split("/"))), t), default=None)


def test_match_equals_trying_every_template(spark):
    rng = random.Random(7)
    parts = ["a", "b", "7", "{id}", ":x", "@y", "", "*", "=", "{id"]
    known = sorted({"/" + "/".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(150)})
    paths = sorted({"/" + "/".join(rng.choices(["a", "b", "7", "", "*", "z"], k=rng.randint(1, 4)))
                    for _ in range(300)})
    got = catalog.match_catalog(
        requests(spark, [("GET", p + "?q=1", "", {}) for p in paths]),
        templates(spark, [("get", t, t) for t in known]),
    ).collect()
    assert len(got) == len(paths)
    assert {r.match_path: r.matched_path for r in got} == {p: best_template(p, known) for p in paths}


def test_decisions_and_upsert(spark):
    listed = templates(
        spark,
        [("get", "/u/{id}", "E1"), ("get", "/p/7", "E2"), ("get", "/n/{id}", None),
         ("post", "/u", "E3")],
    )
    asked = requests(
        spark,
        [
            ("GET", "/u/5?x=1", "", {"Host": "s"}),
            ("GET", "/p/7", "", {}),
            ("GET", "/n/1", "", {}),
            ("DELETE", "/u/9", " old ", {}),
            ("DELETE", "/u/8", " new\r\n", {}),
            ("POST", "u", '{"a": 1}', {"Content-Type": "text/x"}),
        ],
    )
    actions = catalog.plan_catalog_actions(catalog.match_catalog(asked, listed)).cache()
    assert [(r.action, r.template) for r in actions.orderBy("id").collect()] == [
        ("COMMIT", "/u/{id}"), ("ADD", "/p/{id}"), ("FAIL", None), ("ADD", "/u/{id}"),
        ("ADD", "/u/{id}"), ("COMMIT", "/u"),
    ]
    assert {r.action: r.requests for r in catalog.action_counts(actions).collect()} == {
        "ADD": 3, "COMMIT": 2, "FAIL": 1,
    }
    after = catalog.apply_to_catalog(listed.withColumn("body_example", F.lit("was")), actions)
    rows = {(r.method, r.path): (r.status, r.endpoint_id, r.body_example) for r in after.collect()}
    assert rows[("get", "/u/{id}")] == ("updated", "E1", "was")
    assert rows[("get", "/p/7")] == ("kept", "E2", "was")
    assert rows[("get", "/n/{id}")] == ("kept", None, "was")
    assert rows[("post", "/u")] == ("updated", "E3", '{"a": 1}')
    assert rows[("delete", "/u/{id}")][0::2] == ("added", "new")
    assert rows[("get", "/p/{id}")][0::2] == ("added", None) and len(rows) == 6
    seen = {(r.endpoint_id, r.kind, r.name): r.value
            for r in catalog.endpoint_parameters(actions).collect()}
    assert seen == {("E1", "query", "x"): "1", ("E1", "path", "id"): "5",
                    ("E1", "header", "Host"): "s", ("E3", "header", "Content-Type"): "text/x"}

    def documents(df):
        return {r.id: json.loads(r.document) for r in df.collect()}

    assert documents(payloads.match_request_json(asked))["5"] == {
        "requests": [{"method": "POST", "url": "/u", "requestHeaders": {"Content-Type": "text/x"},
                      "requestBody": '{"a": 1}'}]
    }
    assert documents(payloads.add_request_json(actions))["4"] == [
        {"method": "delete", "endpoint": "/u/{id}", "payload": "new"}
    ]
    from apilens.functions.paths import path_params, query_params

    commits = documents(payloads.commit_request_json(
        actions.withColumn("path_params", path_params(F.col("matched_path"), F.col("match_path")))
        .withColumn("query_params", query_params(F.col("endpoint")))
    ))
    assert commits["0"]["endpoints"] == [
        {"endpointId": "E1", "include": True, "pathParams": {"id": "5"}, "queryParams": {"x": "1"},
         "headers": {"Host": "s"}}
    ]
    assert commits["5"]["endpoints"][0]["requestBodyExample"] == {
        "contentType": "text/x", "content": '{"a": 1}'
    }
    update = payloads.update_request_json(
        actions.withColumn("query_params", query_params(F.col("endpoint"))), keep=["id"]
    )
    assert documents(update)["0"] == {
        "eventType": "UPDATE", "eventData": {"queryParams": [{"name": "x", "value": "1"}]}
    }


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_upsert_by_path_equals_upsert_by_request(spark):
    """Random requests, with bodies of blanks, repeated paths, no path, templates without id and raw ones."""
    draw = random.Random(9)
    paths = ["/u/1", "/u/2?x=1", "u/3", "", "/", None, "/u/a", "/u/1/o/2", "/p/7", "/p/8", "/none?a", "/u/{id}"]
    rows = [
        (draw.choice(("GET", "get", "POST")), draw.choice(paths), draw.choice((None, "", "  ", " b%d " % i, "b")), None)
        for i in range(300)
    ]
    asked = requests(spark, rows).repartition(3)
    known = templates(
        spark,
        [("get", "/u/{id}", "e1"), ("post", "/u/{id}", None), ("get", "/u/{a}/o/:b", "e2"), ("get", "/p/7", "e3"), ("get", "/q", "e4")],
    )
    listed = known.withColumn("body_example", F.lit("was"))
    actions = catalog.plan_catalog_actions(catalog.match_catalog(asked, known))
    want = catalog.apply_to_catalog(listed, actions)
    got = catalog.upsert_catalog(listed, known, asked)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    changed = catalog.catalog_changes(listed, actions)
    assert sorted(map(str, changed.collect())) == sorted(map(str, want.filter("status <> 'kept'").collect()))
    # no request meets a join
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "request_body" not in plan[: plan.index("Join")] and plan.count("request_body") > 0
    assert exchanges(got) < exchanges(want)


def test_catalog_listing(spark):
    listing = {"endpointGroups": [
        {"endpoints": [{"method": "GET", "path": "a", "id": "1"}, {"method": "get", "path": "/b"}]},
        {"endpoints": []},
        {},
        {"endpoints": [{"method": "get", "path": "/a", "id": "2"}, {"path": "/c", "id": "3"}]},
    ]}
    df = spark.createDataFrame(
        [("a", "i", json.dumps(listing)), ("a", "bad", "not json")],
        "appId string, instanceId string, document string",
    )
    exploded = catalog.explode_catalog(parse_catalog_listings(df))
    assert [(r.catalog_key, r.endpoint_id) for r in catalog.flatten_catalog(exploded).collect()] == [
        ("get:/a", "2")
    ]
    assert catalog.catalog_templates(exploded).count() == 2


def test_onboarding(spark):
    def app(number, name, *instances):
        return {"applicationId": f"A{number}", "applicationName": name,
                "instances": [{"instanceId": i, "instanceName": i} for i in instances]}

    listing = {"applications": [app(1, "one", "i1", "i2"), app(2, "one", "x"), app(3, "none"),
                                app(4, "Case", "i4")], "nextToken": None}
    flat = onboarding.flatten_applications(parse_application_listings(
        spark.createDataFrame([(0, json.dumps(listing))], "listing bigint, document string")
    ))
    wanted = spark.createDataFrame([("one",), ("none",), ("case",), ("one",)], "service string")
    assert onboarding.plan_onboarding(wanted, flat).count() == 0
    plan = onboarding.plan_onboarding(wanted, flat, auto_onboard=True)
    rows = {r.service: (r.action, r.application_id, r.instance_id) for r in plan.collect()}
    assert rows == {"one": ("REUSE", "A1", "i1"), "none": ("CREATE_INSTANCE", "A3", None),
                    "case": ("CREATE_APP", None, None)}
    assert [tuple(r) for r in onboarding.onboarded_mappings(plan).collect()] == [("one", "A1", "i1")]
    asked = {r.service: json.loads(r.document) for r in onboarding.instance_request_json(plan).collect()}
    assert asked["none"] == {
        "instanceRequestItems": [{"hostUrl": "/", "instanceName": "none_instance"}]
    }
    (spec,) = onboarding.empty_spec_json(plan).collect()
    assert json.loads(spec.document)["paths"] == {} and spec.service == "case"


def test_mapping_precedence(spark):
    def table(rows):
        return spark.createDataFrame(rows, schemas.SERVICE_MAPPINGS)

    base = table([("a", "1", "1"), ("b", "1", ""), ("c", "1", None)])
    saved = table([("a", None, "9"), ("d", "2", "2")])
    over = services.overlay_mappings(base, saved)
    rows = {r.service: (r.appId, r.instanceId, r.origin) for r in over.collect()}
    assert rows == {"a": (None, "9", "replaced"), "b": ("1", "", "base"),
                    "c": ("1", None, "base"), "d": ("2", "2", "added")}
    assert [r.service for r in services.usable_mappings(over).collect()] == ["d"]
    merged = services.merge_mappings(saved, table([("a", "5", "5")]))
    assert {r.service: r.appId for r in merged.collect()} == {"a": "5", "d": "2"}
    twice = table([("a", "1", "1"), ("a", "3", "3"), ("a", "2", "2")]).withColumn(
        "position", F.when(F.col("appId") == "1", 9).otherwise(1)
    )
    once = services.overlay_mappings(twice, table([]))
    assert [(r.service, r.appId) for r in once.collect()] == [("a", "1")]
    assert [r.appId for r in services.last_mappings(twice.drop("position")).collect()] == ["3"]
    asked = spark.createDataFrame([("a",), ("d",)], "service string")
    assert [r[0] for r in services.configured_services(asked, over).collect()] == ["d"]


def test_address_directory(spark):
    pods = spark.createDataFrame(
        [("1", "x", "p1", {"app": "A", "service": "S"}), ("2", "x", "p2", {"service": "S"}),
         ("3", "x", "p3", {}), ("4", "x", "p4", {"app": ""})],
        schemas.PODS,
    )
    svcs = spark.createDataFrame([(str(i), "y", f"svc{i}") for i in (1, 3, 5)], schemas.K8S_SERVICES)
    directory = services.address_directory(pods, svcs)
    assert {r.ip: r.ip_service for r in directory.collect()} == {
        "1": "A", "2": "S", "3": "svc3", "5": "svc5",
    }
    records = spark.createDataFrame(
        [("h.ns:80", "1"), ("10.0.0.1", "3"), (None, "9"), ("", "2")],
        "host string, destination_ip string",
    )
    assert sorted(r.service for r in services.with_service(records, directory).collect()) == [
        "S", "h", "svc3", "unknown",
    ]
