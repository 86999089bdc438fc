"""Streams give what the batch plans give."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from apilens import schemas
from apilens.operators.messages import correlate, http_records, parse_messages, to_http_messages
from apilens.operators.reassembly import messages_only, reassemble
from apilens.operators.services import address_directory, with_service
from apilens.sources import captures
from apilens.sources.segments import dedup_segments, read_segments
from apilens.streaming import assembly
from apilens.streaming import capture as keyed
from apilens.streaming import catalog as jobs
from apilens.streaming import extract as extracts

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
CLIENT, SERVER = ("10.244.0.1", 4000), ("10.96.0.1", 80)


def rows():
    """One connection: messages cut across files, copies, a response that uses an old request."""
    request = b"POST /a/%d HTTP/1.1\r\nHost: 10.96.0.1\r\nContent-Length: 30\r\n\r\n" + b"x" * 30
    answer = b"HTTP/1.1 200 OK\r\nContent-Length: 10\r\n\r\n" + b"y" * 10
    out, clock, sent = [], 0, {CLIENT: 0, SERVER: 0}
    for i in range(9):
        pieces = [(CLIENT, SERVER, request % i), (SERVER, CLIENT, answer)]
        if i == 4:
            pieces = pieces[1:]
        for source, destination, data in pieces:
            for k in range(0, len(data), 25):
                clock += 700
                ts = START + timedelta(milliseconds=clock)
                for iface in ("eth0", "veth1"):
                    out.append((ts, "n", iface, *source, *destination, sent[source],
                                data[k : k + 25]))
                    ts += timedelta(microseconds=9)
                sent[source] += 25
    return out


@pytest.fixture
def directory(spark):
    return address_directory(
        spark.createDataFrame([("10.96.0.1", "d", "p", {"app": "svc"})], schemas.PODS),
        spark.createDataFrame([], schemas.K8S_SERVICES),
    )


@pytest.fixture
def stored(spark, tmp_path):
    """Three files; both cuts are inside a message."""
    path, data = str(tmp_path / "in"), rows()
    third = len(data) // 6 * 2
    for part in (data[:third], data[third : 2 * third], data[2 * third :]):
        spark.createDataFrame(part, schemas.SEGMENTS).coalesce(1).write.mode("append").parquet(path)
    return path


def batch_result(spark, path, directory):
    parsed = http_records(
        parse_messages(messages_only(reassemble(dedup_segments(read_segments(spark, path)))))
    )
    return to_http_messages(correlate(with_service(parsed, directory)))


def plain(df):
    columns = ["type", "service", "method", "endpoint", "host", "status_code", "request_body",
               "response_body", "id"]
    return sorted(map(str, df.select(F.unix_micros("ts"), *columns).collect()))


def test_keyed_stream_equals_batch(spark, tmp_path, stored, directory):
    stream = read_segments(spark, stored, streaming=True, max_files_per_trigger=1)
    records = to_http_messages(keyed.paired_records(keyed.assemble_stream(stream), directory))
    out = str(tmp_path / "out")
    keyed.store_captures(records, out, str(tmp_path / "checkpoint")).awaitTermination()
    want = batch_result(spark, stored, directory)
    got = captures.read_captures(spark, out)
    assert plain(got) == plain(want) and got.count() == 17
    assert {r.service for r in got.collect()} == {"svc"}


def test_batched_stream_equals_batch(spark, tmp_path, stored, directory):
    root = str(tmp_path / "state")
    assembly.start_state(spark, root)
    for _ in range(2):
        assembly.assemble_batches(
            read_segments(spark, stored, streaming=True, max_files_per_trigger=1),
            root, f"{root}/out", f"{root}/checkpoint", lambda: directory,
        ).awaitTermination()
    got = captures.read_captures(spark, f"{root}/out")
    assert plain(got) == plain(batch_result(spark, stored, directory))


def test_repeated_batch_changes_nothing(spark, tmp_path, stored, directory):
    root = str(tmp_path / "state")
    assembly.start_state(spark, root)
    run = assembly.assemble_batch(root, f"{root}/out", lambda: directory)
    batch = read_segments(spark, stored)
    run(batch, 0)
    once = plain(captures.read_captures(spark, f"{root}/out"))
    run(batch, 0)
    assert plain(captures.read_captures(spark, f"{root}/out")) == once


def test_idle_state_is_dropped(spark, tmp_path, directory):
    root = str(tmp_path / "state")
    assembly.start_state(spark, root)
    run = assembly.assemble_batch(root, f"{root}/out", lambda: directory, idle_seconds=60)

    def segments(second, payload, port):
        ts = START + timedelta(seconds=second)
        return spark.createDataFrame(
            [(ts, "n", "eth0", "10.0.0.1", port, "10.0.0.2", 80, 0, payload)], schemas.SEGMENTS
        )

    run(segments(0, b"GET /half", 1), 0)
    run(segments(300, b"GET /x HTTP/1.1\r\n\r\n", 2), 1)
    assert spark.read.parquet(f"{root}/open/batch=0").count() == 1
    assert spark.read.parquet(f"{root}/open/batch=1").count() == 0
    run(segments(301, b" HTTP/1.1\r\n\r\n", 1), 2)
    assert captures.read_captures(spark, f"{root}/out").count() == 1


def test_copies_in_a_stream(spark, tmp_path, stored):
    stream = keyed.dedup_stream(read_segments(spark, stored, streaming=True))
    query = (
        stream.writeStream.format("memory").queryName("copies")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.table("copies").count() == len(rows()) // 2


def test_incremental_extract(spark, tmp_path):
    folder = tmp_path / "captures"
    folder.mkdir()

    def line(number, endpoint="/a"):
        return (f'{{"id": "{number}", "type": "request", "endpoint": "{endpoint}", '
                '"timestamp": "2024-01-01T00:00:00Z", "method": "GET"}\n')

    def run():
        extracts.extract_new(
            spark, str(folder), str(tmp_path / "out"), str(tmp_path / "checkpoint")
        ).awaitTermination()
        return sorted(r.id for r in spark.read.json(str(tmp_path / "out")).collect())

    (folder / "one.json").write_text(line(1) + "broken\n" + line(2, "/healthz"))
    assert run() == ["1"]
    assert run() == ["1"]
    (folder / "two.json").write_text(line(3))
    assert run() == ["1", "3"]


def test_catalog_stream_onboards_once(spark, tmp_path):
    root, path = str(tmp_path / "root"), str(tmp_path / "in")
    schema = schemas.HTTP_MESSAGES

    def add(number, service, endpoint):
        row = {"id": str(number), "type": "request", "ts": START + timedelta(seconds=number),
               "service": service, "method": "GET", "endpoint": endpoint, "request_body": ""}
        names = [part.split()[0] for part in schema.split(", ")]
        spark.createDataFrame([tuple(row.get(n) for n in names)], schema).coalesce(1).write.mode(
            "append"
        ).parquet(path)

    apps = spark.createDataFrame(
        [(0, 0, "A", "new", 0, "I", "x")],
        "listing int, app_pos int, application_id string, application_name string, "
        "instance_pos int, instance_id string, instance_name string",
    )
    empty = spark.createDataFrame([], schemas.CATALOG)
    jobs.start_versions(empty, spark.createDataFrame([], schemas.SERVICE_MAPPINGS), root)
    for number, (service, endpoint) in enumerate(
        [("new", "/u/1"), ("new", "/u/2"), ("unknown", "/x"), ("other", "/y")]
    ):
        add(number, service, endpoint)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = jobs.maintain_catalog(stream, root, f"{root}/checkpoint", lambda: apps, auto_onboard=True)
    query.awaitTermination()
    tables = jobs.CatalogTables(spark, root)
    last = tables.last()
    rows_ = tables.catalog.read(last).collect()
    assert [(r.appId, r.instanceId, r.method, r.path) for r in rows_] == [("A", "I", "get", "/u/{id}")]
    mapped = tables.mappings.read(last).collect()
    assert [tuple(r) for r in mapped] == [("new", "A", "I")]


@pytest.mark.parametrize("plan", ["keyed", "batches"])
def test_copies_in_different_micro_batches(spark, tmp_path, plan):
    """A copy that comes with the next micro-batch is a copy all the same."""
    path, root = str(tmp_path / "in"), str(tmp_path)
    get = b"GET /a HTTP/1.1\r\nHost: x\r\n\r\n"
    flow = ("n1", "eth0", "10.0.0.1", 4000, "10.0.0.2", 80)
    for ms, seq in ((0, 1), (3, 1), (20_000, 1), (20_001, 2)):
        row = (START + timedelta(milliseconds=ms), *flow, seq, get)
        spark.createDataFrame([row], schemas.SEGMENTS).coalesce(1).write.mode("append").parquet(path)
    stream = read_segments(spark, path, streaming=True, max_files_per_trigger=1)
    directory = spark.createDataFrame([], "ip string, ip_service string")
    if plan == "keyed":
        paired = keyed.paired_records(keyed.assemble_stream(stream), directory)
        keyed.store_captures(to_http_messages(paired), f"{root}/out", f"{root}/check").awaitTermination()
    else:
        assembly.start_state(spark, root)
        assembly.assemble_batches(stream, root, f"{root}/out", f"{root}/check", lambda: directory).awaitTermination()
    pattern = f"{root}/out" if plan == "keyed" else f"{root}/out/*"
    assert captures.read_captures(spark, pattern).count() == 3


def test_many_short_batches_equal_batch(spark, tmp_path, directory):
    """A copy comes two micro-batches later, within the gap."""
    request = b"GET /a/%d HTTP/1.1\r\nHost: 10.96.0.1\r\n\r\n"
    parts = []
    for i in range(3):
        ts = START + timedelta(seconds=1.2 * i)
        own = [(ts, "n", "eth0", *CLIENT, *SERVER, 100 * i, request % i)]
        if i == 2:
            own.append((ts, "n", "veth1", *CLIENT, *SERVER, 0, request % 0))
        parts.append(spark.createDataFrame(own, schemas.SEGMENTS))
    root = str(tmp_path / "state")
    assembly.start_state(spark, root)
    run = assembly.assemble_batch(root, f"{root}/out", lambda: directory)
    for number, part in enumerate(parts):
        run(part, number)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    got = captures.read_captures(spark, f"{root}/out")
    assert plain(got) == plain(batch_result(spark, str(tmp_path / "in"), directory)) and got.count() == 3


def test_expired_bytes_come_out_open(spark, tmp_path, directory):
    root = str(tmp_path / "state")
    assembly.start_state(spark, root)
    run = assembly.assemble_batch(root, f"{root}/out", lambda: directory, idle_seconds=60)
    for number, (port, seconds) in enumerate(((1, 0), (2, 90))):
        row = (START + timedelta(seconds=seconds), "n", "eth0", CLIENT[0], port, *SERVER, 0, b"GET /x HTTP/1.1\r\n")
        run(spark.createDataFrame([row], schemas.SEGMENTS), number)
    got = spark.read.parquet(f"{root}/expired/batch=0", f"{root}/expired/batch=1").collect()
    assert [(r.kind, bytes(r.message)) for r in got] == [("open", b"GET /x HTTP/1.1\r\n")]


HALF = b"POST /a HTTP/1.1\r\nHost: x\r\nContent-Length: 60\r\n\r\n" + b"x" * 20
WHOLE = b"GET /b HTTP/1.1\r\nHost: x\r\n\r\n"


@pytest.mark.parametrize("cuts", [(1, 2), (1, 2, 3), (3,)])
@pytest.mark.parametrize("plan", ["keyed", "batches"])
def test_nothing_is_lost(spark, tmp_path, plan, cuts):
    """Flows that resume after a silence, that never do, with foreign bytes and without ports: as the batch plan,
    wherever the micro-batches are cut."""
    if plan == "keyed" and cuts not in ((1, 2), (3,)):
        return
    flows = [("n", "eth0", "10.0.0.1", 1, "10.0.0.2", 80), ("n", "eth0", "10.0.0.1", 2, "10.0.0.2", 80),
             ("n", "eth0", "10.0.0.1", None, "10.0.0.2", None)]
    times = [
        [(0, 0, HALF), (0, 1, HALF), (1, 2, HALF)],
        [(700, 0, b"~~" + WHOLE), (710, 2, WHOLE[:9])],
        [(705, 0, HALF)],
        [(2000, 0, WHOLE), (4000, 0, WHOLE)],
    ]
    batches, number = [], 0
    for i, part in enumerate(times):
        if i == 0 or i in cuts:
            batches.append([])
        for seconds, flow, payload in part:
            number += 1
            batches[-1].append((START + timedelta(seconds=seconds), *flows[flow], number, payload))
    path, root = str(tmp_path / "in"), str(tmp_path / "root")
    for batch in batches:
        spark.createDataFrame(batch, schemas.SEGMENTS).coalesce(1).write.mode("append").parquet(path)
    want = reassemble(read_segments(spark, path)).filter("kind <> 'message'")
    stream = read_segments(spark, path, streaming=True, max_files_per_trigger=1)
    if plan == "batches":
        assembly.start_state(spark, root)
        none = spark.createDataFrame([], "ip string, ip_service string")
        assembly.assemble_batches(stream, root, f"{root}/out", f"{root}/check", lambda: none).awaitTermination()
        got = assembly.leftovers(spark, root, len(batches) - 1)
        assert captures.read_captures(spark, f"{root}/out").count() == 3
        assert spark.read.parquet(f"{root}/open/batch={len(batches) - 1}").count() == 0
    else:
        query = keyed.assemble_stream(stream, delay="0 seconds").writeStream.format("memory").queryName("left").option(
            "checkpointLocation", f"{root}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table("left").filter("kind = 'message'").count() == 3
        got = spark.table("left").filter("kind <> 'message'").withColumnRenamed("message", "data")
    columns = ["src_port", "kind", "data"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    assert want.count() == 6


def test_long_body_in_keyed_state(spark, tmp_path):
    """A body over many micro-batches; its parts are stored once each."""
    path = str(tmp_path / "in")
    message = b"POST /a HTTP/1.1\r\nHost: x\r\nContent-Length: 50\r\n\r\n" + bytes(range(50)) + WHOLE
    for i in range(0, len(message), 20):
        row = (START + timedelta(seconds=i), "n", "eth0", *CLIENT, *SERVER, i, message[i : i + 20])
        spark.createDataFrame([row], schemas.SEGMENTS).coalesce(1).write.mode("append").parquet(path)
    stream = read_segments(spark, path, streaming=True, max_files_per_trigger=1)
    keyed.assemble_stream(stream).writeStream.format("memory").queryName("long").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = [bytes(r.message) for r in spark.table("long").orderBy("ts", "n").collect()]
    assert got == [message[: -len(WHOLE)], WHOLE]


def test_catalog_versions_under_retries(spark, tmp_path):
    """A micro-batch that runs again, also after its files were written in part, gives the same; an application that has to
    be created is asked for once; saved mappings are read anew."""
    root = str(tmp_path / "root")
    schema = schemas.HTTP_MESSAGES
    names = [part.split()[0] for part in schema.split(", ")]

    def batch(*rows):
        full = [
            {"id": i, "type": "request", "ts": START + timedelta(seconds=n), "service": service, "method": "GET",
             "endpoint": endpoint, "request_body": "", "request_headers": {"A": i}}
            for n, (i, service, endpoint) in enumerate(rows)
        ]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schema)

    apps = spark.createDataFrame(
        [(0, 0, "A", "new", 0, "I", "x")],
        "listing int, app_pos int, application_id string, application_name string, "
        "instance_pos int, instance_id string, instance_name string",
    )
    saved = {0: [], 1: [("late", "L", "J"), ("half", "H", "")], 2: [("late", "L2", "J")]}

    def mappings(number):
        return spark.createDataFrame(saved[number], schemas.SERVICE_MAPPINGS)

    tables = jobs.CatalogTables(spark, root, compact_every=2)
    tables.start(spark.createDataFrame([], schemas.CATALOG), spark.createDataFrame([], schemas.SERVICE_MAPPINGS))
    run = jobs.apply_batch(root, lambda: apps, True, mappings, compact_every=2)
    batches = [
        batch(("1", "new", "/u/1"), ("2", "make", "/m"), ("3", "late", "/l")),
        batch(("4", "new", "/u/2?a=1"), ("5", "make", "/m"), ("6", "late", "/l/7"), ("7", "half", "/h")),
        batch(("8", "late", "/l/8"), ("9", "new", "/u/3?a=2")),
    ]
    for number, rows_ in enumerate(batches):
        run(rows_, number)
        run(rows_, number)
    assert tables.last() == 2
    assert sorted((r.appId, r.path) for r in tables.catalog.read(2).collect()) == [
        ("A", "/u/{id}"), ("L", "/l/{id}"), ("L2", "/l/{id}")]
    assert sorted((r.service, r.action, r.first_id) for r in tables.onboarding.read(2).collect()) == [
        ("half", "CREATE_APP", "7"), ("late", "CREATE_APP", "3"), ("make", "CREATE_APP", "2"), ("new", "REUSE", "1")]
    assert sorted((r.kind, r.name, r.value, r.times_seen) for r in tables.parameters.read(2).collect()) == [
        ("header", "A", "9", 2), ("path", "id", "3", 2), ("query", "a", "2", 2)]
    assert [r.service for r in tables.mappings.read(2).collect()] == ["new"]


def test_connections_share_a_bucket(spark, tmp_path, directory):
    """Many connections in one call, bodies cut across micro-batches, give what the batch plan gives."""
    path, data = str(tmp_path / "in"), rows()
    ports = {4000: 4001, 80: 80}
    data = [r[:4] + (port(r[4]),) + (r[5],) + (port(r[6]),) + r[7:] for port in (int, ports.get) for r in data]
    data.sort(key=lambda r: r[0])
    third = len(data) // 6 * 2
    for part in (data[:third], data[third : 2 * third], data[2 * third :]):
        spark.createDataFrame(part, schemas.SEGMENTS).coalesce(1).write.mode("append").parquet(path)
    stream = read_segments(spark, path, streaming=True, max_files_per_trigger=1)
    records = to_http_messages(keyed.paired_records(keyed.assemble_stream(stream, buckets=1), directory))
    out = str(tmp_path / "out")
    keyed.store_captures(records, out, str(tmp_path / "checkpoint")).awaitTermination()
    got = captures.read_captures(spark, out)
    assert plain(got) == plain(batch_result(spark, path, directory)) and got.count() == 34
