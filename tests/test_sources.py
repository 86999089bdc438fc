"""Readers and writers on files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from apilens import schemas
from apilens.operators import extract
from apilens.plans import capture_view as view
from apilens.plans import registry
from apilens.sources import captures, documents, segments

SF = "/root/testdata/sf0.001"


def record(number, **fields):
    return json.dumps(
        {"id": str(number), "type": "request", "timestamp": "2024-01-01T00:00:00.5Z",
         "endpoint": "/a", "method": "GET", **fields}
    )


def test_capture_files_of_several_nodes(spark, tmp_path):
    one, two = tmp_path / "one.json", tmp_path / "two.json"
    one.write_text("\n".join([record(1), "", "  ", "{broken", record(2)[:-4], f"  {record(3)}  "]))
    two.write_text(record(4, node="n2", status_code=200, response_headers={"A": "b"}))
    rows = captures.read_captures(spark, str(one), str(two)).orderBy("id").collect()
    assert [r.id for r in rows] == ["1", "3", "4"]
    assert rows[2].response_headers == {"A": "b"} and rows[0].ts.microsecond == 500_000


def test_records_without_id(spark, tmp_path):
    file = tmp_path / "one.json"
    file.write_text("\n".join(['{"method": "PUT"}', "{}", "[]", "7", '"x"', "null", '{"method": "GET"', '{"status_code": "x"}']))
    assert sorted(str(r.method) for r in captures.read_captures(spark, str(file)).collect()) == ["None", "PUT"]


def test_positions_of_stored_captures(spark, tmp_path):
    """Positions count lines over all files and stay as they are when files are added."""
    first, second = tmp_path / "b.json", tmp_path / "a.json"
    first.write_text("\n".join([record(n) for n in range(3000)] + ["broken", record(3000)]))
    os.utime(first, (1_000, 1_000))
    got = captures.read_positioned_captures(spark, str(tmp_path))
    assert {int(r.id): r.position for r in got.collect()} == {n: n + 1 for n in range(3000)} | {3000: 3002}
    path = str(tmp_path / "position")
    captures.write_position(got, path)
    second.write_text("\n".join(record(n) for n in range(5000, 5003)))
    later = captures.read_positioned_captures(spark, str(first), str(second))
    new = extract.new_since(later, captures.read_position(spark, path))
    assert sorted((int(r.id), r.position) for r in new.collect()) == [(5000, 3003), (5001, 3004), (5002, 3005)]


def test_capture_log(spark, tmp_path):
    log = tmp_path / "pod.log"
    log.write_text(f"starting\nENDPOINT_CAPTURE: {record(1)}\nENDPOINT_CAPTURE: oops\n{record(2)}\n")
    assert [r.id for r in captures.read_capture_log(spark, str(log)).collect()] == ["1"]


def test_append_and_overwrite(spark, tmp_path):
    messages = view.http_messages_view(spark, SF).limit(5).cache()
    path = str(tmp_path / "captures")
    captures.write_captures(messages, path)
    captures.write_captures(messages, path)
    assert captures.read_captures(spark, path).count() == 10
    captures.write_captures(messages, path, "overwrite")
    back = captures.read_captures(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, messages.collect()))


@pytest.mark.parametrize("text", ["not json", "", "[]", "{}", '{"serviceMappings": 5}'])
def test_bad_config_gives_defaults(spark, tmp_path, text):
    file = tmp_path / "config.json"
    file.write_text(text)
    config = documents.service_config(
        documents.read_documents(spark, str(file), schemas.SERVICE_CONFIG)
    )
    for row in config.collect():
        assert (row.has_api_key, row.auto_onboard, row.service_mappings) == (False, False, {})
    assert documents.read_service_mappings(spark, str(file)).count() == 0


def test_config(spark, tmp_path):
    file = tmp_path / "config.json"
    file.write_text(json.dumps({
        "apiKey": " k ", "autoOnboardNewServices": True,
        "serviceMappings": {"a": {"appId": "1", "instanceId": "2"}, "b": {"appId": "3"}},
    }, indent=2))
    config = documents.service_config(
        documents.read_documents(spark, str(file), schemas.SERVICE_CONFIG)
    )
    assert (config.first().has_api_key, config.first().auto_onboard) == (True, True)
    rows = documents.read_service_mappings(spark, str(file)).orderBy("service").collect()
    assert [tuple(r) for r in rows] == [("a", "1", "2"), ("b", "3", None)]


def test_saved_mappings(spark, tmp_path):
    table = spark.createDataFrame([("a", "1", "2"), ("b", None, "")], schemas.SERVICE_MAPPINGS)
    path = str(tmp_path / "saved")
    documents.write_mappings(table, path)
    assert sorted(map(tuple, documents.read_saved_mappings(spark, path).collect())) == sorted(
        map(tuple, table.collect())
    )
    (tmp_path / "saved" / "part-broken.json").write_text("{oops\n")
    assert documents.read_saved_mappings(spark, path).count() == 2


def test_position(spark, tmp_path):
    path = str(tmp_path / "state")
    assert captures.read_position(spark, path) == 0
    captures.write_position(spark.range(5).withColumnRenamed("id", "position"), path)
    assert captures.read_position(spark, path) == 4
    for part in (tmp_path / "state").glob("part-*"):
        part.write_text("garbage\n")
    for crc in (tmp_path / "state").glob(".part-*.crc"):
        crc.unlink()
    assert captures.read_position(spark, path) == 0


def test_report(spark, tmp_path):
    records = view.messages_view(spark, SF).withColumn("service", F.lit("s"))
    from apilens.operators.messages import to_http_messages

    positioned = to_http_messages(records, keep=["position"])
    path = str(tmp_path / "report")
    kept = extract.drop_health_checks(positioned)
    captures.write_extract_report(
        extract.project_extract(kept), extract.extract_metadata(positioned), path
    )
    meta = spark.read.json(f"{path}/metadata").first()
    assert meta.total_endpoints == spark.read.json(f"{path}/endpoints").count() == kept.count()
    assert meta.total_in_file == records.count() and meta.extracted_at.endswith("Z")
    line = json.loads(spark.read.text(f"{path}/endpoints").filter("value like '%GET%'").first()[0])
    order = [k for k in ("id", "timestamp", "service", "method", "endpoint", "full_url", "type", "headers")]
    assert [k for k in line if k in order] == order and "response_body" not in line


def test_segment_table(spark, tmp_path):
    path = str(tmp_path / "segments")
    view.segments_view(spark, SF).drop("type").limit(10).write.parquet(path)
    spark.createDataFrame(
        [(None, "n", "e", "1", 1, "2", 2, 0, b"")], schemas.SEGMENTS
    ).write.mode("append").parquet(path)
    assert segments.read_segments(spark, path).count() == 10
    assert segments.read_segments(spark, path, streaming=True).isStreaming


def test_pushdown(spark, tmp_path):
    """The port filter and the column list reach the Parquet scan."""
    path = str(tmp_path / "pushed")
    view.segments_view(spark, SF).drop("type").write.parquet(path)
    wanted = segments.http_port_filter(segments.read_segments(spark, path)).select("src_ip")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "In(src_port" in plan.split("PushedFilters")[1]
    assert "iface" not in plan.split("ReadSchema")[1]


def test_captures_are_stored_compressed_and_read_beside_plain_ones(spark, tmp_path):
    path = tmp_path / "captures"
    captures.write_captures(view.http_messages_view(spark, SF).limit(50), str(path))
    stored = [name for name in os.listdir(path) if name.startswith("part-")]
    assert stored and all(name.endswith(".json.gz") for name in stored)
    (path / "plain.json").write_text(record("plain"))
    assert captures.read_captures(spark, str(path)).count() == 51
    positions = sorted(r.position for r in captures.read_positioned_captures(spark, str(path)).collect())
    assert positions == list(range(1, 52))


def test_lines_are_not_shuffled_to_get_their_positions(spark, tmp_path):
    (tmp_path / "one.json").write_text(record(1))
    plan = captures.read_positioned_captures(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_time_ranges_are_cut_from_a_table_computed_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    rows = spark.range(90).selectExpr("timestamp_micros(id * 1000) as ts", "id")
    path = str(tmp_path / "in")
    files = registry._in_order(rows.mapInArrow(count, rows.schema), path, parts=3)
    assert calls.value == 90
    assert len([name for name in os.listdir(path) if name.startswith("part-")]) == 3 * files
    assert spark.read.parquet(path).count() == 90
