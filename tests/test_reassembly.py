"""Framing, chunk hand-over, packets, copies."""

import random
import struct
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from apilens import schemas
from apilens.operators import reassembly
from apilens.operators.messages import http_records, malformed, parse_messages
from apilens.operators.reassembly import (
    _ENTRY,
    _SEGMENT,
    FRESH,
    OPEN_FLOWS,
    Framer,
    _one_message,
    _open_edges,
    messages_only,
    reassemble,
    reassemble_onto,
    rejects_only,
)
from apilens.sources import segments as seg
from apilens.staging import staged

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(ms: int) -> datetime:
    return START + timedelta(milliseconds=ms)


def segment(ms, payload, flow=("n1", "10.0.0.1", 4000, "10.0.0.2", 80), seq=0, iface="eth0"):
    node, src, sport, dst, dport = flow
    return (at(ms), node, iface, src, sport, dst, dport, seq, payload)


def frame(pieces, state=FRESH):
    framer = Framer(state)
    return [out for piece in pieces for out in framer.feed(piece)], framer


def post(body: bytes, path: bytes = b"/p") -> bytes:
    return b"POST " + path + b" HTTP/1.1\r\nContent-Length: %d\r\n\r\n" % len(body) + body


GET = b"GET /a HTTP/1.1\r\nHost: x\r\n\r\n"


def test_two_requests_in_one_segment():
    out, framer = frame([GET + GET + post(b"1") + GET])
    assert out == [("message", GET), ("message", GET), ("message", post(b"1")), ("message", GET)]
    assert framer.state == FRESH


def test_open_body_waits():
    out, framer = frame([post(b"abc")[:-1]])
    assert out == [] and framer.state[1:] == post(b"abc")[:-1]


def test_garbage_is_rejected_up_to_the_next_start():
    out, _ = frame([b"\x16\x03junk", b" more GE", b"T /a HTTP/1.1\r\nHost: x\r\n\r\n"])
    rejected = b"".join(data for kind, data in out if kind == "reject")
    assert rejected == b"\x16\x03junk more " and out[-1] == ("message", GET)


def test_endless_garbage_does_not_pile_up():
    framer = Framer()
    for _ in range(1000):
        list(framer.feed(b"\x00" * 1000))
    assert len(framer.open) < 20


def test_without_length_the_segment_ends_the_body():
    out, _ = frame([b"HTTP/1.1 200 OK\r\n\r\npart one", b"part two" + GET])
    assert out[0] == ("message", b"HTTP/1.1 200 OK\r\n\r\npart one")
    assert out[-1] == ("message", GET)


@pytest.mark.parametrize("bad", [b"GET\r\n\r\n", b"HTTP/1.1 abc\r\n\r\n", b"HTTP/1.1\r\n\r\n"])
def test_malformed_start_lines_are_rejected(bad):
    out, framer = frame([bad + GET])
    assert out == [("reject", bad), ("message", GET)] and framer.state == FRESH


def test_body_that_looks_like_a_request():
    message = post(b"GET /inner HTTP/1.1\r\n\r\n" * 3)
    out, _ = frame([message[:60], message[60:]])
    assert out == [("message", message)]


bodies = st.binary(max_size=60) | st.just(b"GET /x HTTP/1.1\r\n\r\n") | st.just(b"HTTP/1.1 200 OK")


@settings(max_examples=200, deadline=None)
@given(st.lists(bodies, min_size=1, max_size=6), st.data())
def test_any_cut_gives_the_same_messages(parts, data):
    wanted = [post(body) for body in parts]
    whole = b"".join(wanted)
    cuts = sorted(data.draw(st.lists(st.integers(0, len(whole)), max_size=12)))
    pieces = [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True)]
    out, framer = frame([p for p in pieces if p])
    assert out == [("message", m) for m in wanted] and framer.state == FRESH


def random_traffic(seed: int, flows: int = 5, messages: int = 12):
    """Segments of interleaved flows with inner look-alikes, garbage and lost tails."""
    rng = random.Random(seed)
    rows, clock = [], 0
    for number in range(flows):
        flow = ("n1", f"10.0.0.{number}", 4000 + number, "10.0.1.1", 80)
        data = b""
        for _ in range(messages * (6 if number == 0 else 1)):
            pick = rng.random()
            if pick < 0.6:
                inner = b"GET /inner HTTP/1.1\r\n\r\n" if rng.random() < 0.4 else b""
                data += post(rng.randbytes(rng.randint(0, 80)) + inner, b"/%d" % rng.randint(0, 99))
            elif pick < 0.8:
                data += GET
            elif pick < 0.9:
                data += b"HTTP/1.1 201 CREATED\r\nContent-Length: 2\r\n\r\nok"
            else:
                data += rng.randbytes(rng.randint(1, 40))
        position = 0
        while position < len(data):
            size = rng.randint(1, 90)
            clock += rng.randint(1, 40)
            rows.append(segment(clock + number, data[position : position + size], flow, position))
            position += size
    rng.shuffle(rows)
    return rows


def one_pass(rows):
    """The sequential result: one framer per flow over the segments in arrival order."""
    out, framers = [], {}
    for ts, node, _, src, sport, dst, dport, seq, payload in sorted(
        rows, key=lambda r: (r[0], r[7], r[8])
    ):
        flow = (node, src, sport, dst, dport)
        for n, (kind, data) in enumerate(framers.setdefault(flow, Framer()).feed(payload)):
            out.append((*flow, ts, seq, n, kind, data))
    return sorted(out), {f: x.state for f, x in framers.items() if x.state != FRESH}


def collected(df):
    rows = df.withColumn("ts", F.unix_micros("ts")).collect()
    return sorted(
        (r.node, r.src_ip, r.src_port, r.dst_ip, r.dst_port,
         START + timedelta(microseconds=r.ts - int(START.timestamp() * 1_000_000)),
         r.seq, r.n, r.kind, bytes(r.data))
        for r in rows
    )


@pytest.mark.parametrize(("seed", "chunk"), [(1, "1 microsecond"), (2, "200 millisecond"), (3, "1 hour")])
def test_chunks_do_not_change_the_result(spark, seed, chunk):
    rows = random_traffic(seed)
    got = collected(reassemble(spark.createDataFrame(rows, schemas.SEGMENTS), chunk))
    whole, unfinished = one_pass(rows)
    assert [r for r in got if r[8] != "open"] == whole
    assert {r[:5]: r[9] for r in got if r[8] == "open"} == {
        flow: state[1:] for flow, state in unfinished.items() if len(state) > 1
    }


def test_one_flow_holding_everything(spark):
    """A message across many chunks, then many in one chunk."""
    big = post(bytes(range(256)) * 40)
    pieces = [big[i : i + 500] for i in range(0, len(big), 500)] + [GET] * 50
    rows = [segment(i * 1000, piece, seq=i) for i, piece in enumerate(pieces)]
    got = reassemble(spark.createDataFrame(rows, schemas.SEGMENTS), "3 seconds")
    assert collected(got) == one_pass(rows)[0]
    assert messages_only(got).count() == 51 and rejects_only(got).count() == 0


@pytest.mark.parametrize("whole", [True, False])
def test_a_body_takes_no_more_rounds_over_more_chunks(spark, monkeypatch, whole):
    """As many written tables for a body over 2 chunks as over 200."""
    written = {}
    for chunks in (2, 200):
        big = post(bytes(range(250)) * 4 * chunks)
        pieces = [big[i : i + 500] for i in range(0, len(big), 500)]
        if not whole:
            pieces = pieces[:-1]
        rows = [segment(i * 1000, piece, seq=i) for i, piece in enumerate(pieces)]
        rows += [segment(i * 1000 + 5, GET, ("n1", "10.0.0.9", 1, "10.0.0.2", 80), seq=i) for i in range(3)]
        names = []
        monkeypatch.setattr(reassembly, "staged", lambda df, name, by=(): names.append(name) or staged(df, name, by))
        got = collected(reassemble(spark.createDataFrame(rows, schemas.SEGMENTS), "2 seconds"))
        want, left = one_pass(rows)
        assert [r for r in got if r[8] != "open"] == want
        assert [r[9] for r in got if r[8] == "open"] == [state[1:] for state in left.values()]
        written[chunks] = names
    assert written[2] == written[200]


def with_copies(rows, seed):
    """Some segments again, milliseconds to 25 seconds later, some several times, some without seq."""
    rng = random.Random(seed)
    out = []
    for row in rows:
        row = (*row[:7], None if rng.random() < 0.05 else row[7], row[8])
        out.append(row)
        for _ in range(rng.choice((0, 0, 0, 1, 3))):
            out.append((row[0] + timedelta(milliseconds=rng.choice((1, 900, 9_999, 10_000, 25_000))), *row[1:]))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "chunk"), [(1, "10 seconds"), (2, "1 minute"), (3, "1 hour")])
def test_copies_dropped_on_the_way(spark, seed, chunk):
    """The same as dropping them before, also where copies stand on both sides of a border."""
    rows = with_copies([(START + (r[0] - START) * 30, *r[1:]) for r in random_traffic(seed, flows=3)], seed)
    df = spark.createDataFrame(rows, schemas.SEGMENTS)
    assert collected(reassemble(df, chunk, copy_gap_seconds=10)) == collected(reassemble(seg.dedup_segments(df), "1 hour"))


def test_one_exchange_of_payloads(spark):
    df = spark.createDataFrame([segment(0, GET)], schemas.SEGMENTS)
    framed = reassembly._frame(reassembly._keyed(df, 60_000_000, 10_000_000), 600_000_000, 10_000_000)
    plan = framed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    with pytest.raises(ValueError):
        reassemble(df, "1 second", copy_gap_seconds=10)


def test_missing_parts_of_a_flow(spark):
    flow = ("n1", "10.0.0.1", None, None, 80)
    got = reassemble(spark.createDataFrame([segment(0, GET, flow), segment(1, GET[:5], flow, 1)], schemas.SEGMENTS))
    assert sorted(((r.src_port, r.dst_ip, r.dst_port, r.kind) for r in got.collect()), key=str) == [
        (None, None, 80, "message"), (None, None, 80, "open")]


@pytest.mark.parametrize("chunk", ["1 second", "1 minute", "2 hours"])
def test_silence_starts_a_flow_anew(spark, chunk):
    """A port that is used again does not go on with the body that was never finished."""
    rows = [
        segment(0, post(b"x" * 100)[:60], seq=1),
        segment(500_000, b"yy", seq=2),
        segment(1_200_000, GET, seq=3),
        segment(1_200_500, GET[:9], seq=4),
    ]
    df = spark.createDataFrame(rows, schemas.SEGMENTS)
    got = collected(reassemble(df, chunk))
    assert [(r[8], r[9]) for r in got] == [
        ("open", post(b"x" * 100)[:60] + b"yy"),
        ("message", GET),
        ("open", GET[:9]),
    ]
    first, left = reassemble_onto(spark.createDataFrame(rows[:2], schemas.SEGMENTS), None, chunk)
    second, rest = reassemble_onto(
        spark.createDataFrame(rows[2:], schemas.SEGMENTS),
        spark.createDataFrame(left.collect(), OPEN_FLOWS),
        chunk,
    )
    assert collected(first) + collected(second) == got[:2]
    assert [bytes(r.state)[1:] for r in rest.collect()] == [GET[:9]]


LENGTHS = [
    (b"0000000000000000003", b"abc", True),
    (b"9" * 19, b"abc", False),
    (b"1" * 5000, b"abc", False),
    (b"3", b"abc", True),
]


@pytest.mark.parametrize(("digits", "body", "whole"), LENGTHS)
def test_lengths_of_any_number_of_digits(digits, body, whole):
    message = b"POST /p HTTP/1.1\r\nContent-Length: " + digits + b"\r\n\r\n" + body
    out, framer = frame([message + GET])
    assert out == ([("message", message), ("message", GET)] if whole else [])
    assert framer.state[1:] == (b"" if whole else message + GET)


@pytest.mark.parametrize("bad", [b"a\rContent-Length: 5", b"\xc2\x85Content-Length: 5", b"a\nContent-Length: 5"])
def test_header_lines_end_at_crlf_only(spark, bad):
    message = b"GET /a HTTP/1.1\r\nX: " + bad + b"\r\n\r\n"
    out, framer = frame([message + GET])
    assert out == [("message", message), ("message", GET)] and framer.state == FRESH
    df = spark.createDataFrame(
        [("n", "10.0.0.1", 1, "10.0.0.2", 80, START, 0, 0, message)],
        "node string, src_ip string, src_port int, dst_ip string, dst_port int, ts timestamp, "
        "seq bigint, n int, message binary",
    )
    assert http_records(parse_messages(df)).count() == 1


def chunked(*parts, trailer=b""):
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip, chunked\r\n\r\n"
    body = b"".join(b"%x;a=b\r\n%s\r\n" % (len(p), p) for p in parts)
    return head + body + b"0\r\n" + trailer + b"\r\n", head + b"".join(parts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), max_size=4), st.sampled_from([b"", b"T: 1\r\n"]), st.data())
def test_chunked_bodies(parts, trailer, data):
    raw, plain = chunked(*parts, trailer=trailer)
    whole = raw + post(b"1") + raw
    cuts = sorted(data.draw(st.lists(st.integers(0, len(whole)), max_size=12)))
    pieces = [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True)]
    out, framer = frame([p for p in pieces if p])
    assert out == [("message", plain), ("message", post(b"1")), ("message", plain)] and framer.state == FRESH


def test_two_batches_equal_one(spark):
    rows = sorted(random_traffic(4))
    want, left_open = one_pass(rows)
    half = len(rows) // 2
    first, left = reassemble_onto(spark.createDataFrame(rows[:half], schemas.SEGMENTS), None)
    second, rest = reassemble_onto(
        spark.createDataFrame(rows[half:], schemas.SEGMENTS),
        spark.createDataFrame(left.collect(), OPEN_FLOWS),
        "100 milliseconds",
    )
    assert sorted(collected(first) + collected(second)) == want
    assert {tuple(r.flow.split("|")): bytes(r.state) for r in rest.collect()} == {
        tuple(map(str, flow)): state for flow, state in left_open.items()
    }


def test_dedup_keeps_the_first_copy(spark):
    rows = [
        segment(5, b"a", seq=1, iface="veth1"),
        segment(2, b"a", seq=1),
        segment(3, b"b", seq=1),
        segment(4, b"a", seq=2),
        segment(9_500, b"a", seq=1),
        segment(5 * 3_600_000, b"a", seq=1),
        segment(7, b"n", seq=None),
        segment(8, b"n", seq=None),
    ]
    got = seg.dedup_segments(spark.createDataFrame(rows, schemas.SEGMENTS))
    assert sorted((r.ts.replace(tzinfo=None), bytes(r.payload)) for r in got.collect()) == [
        (at(m).replace(tzinfo=None), p)
        for m, p in [(2, b"a"), (3, b"b"), (4, b"a"), (7, b"n"), (8, b"n"), (18_000_000, b"a")]
    ]


def packet(payload=b"x", proto=6, options=b"", src="10.200.0.255", dst="192.168.1.2",
           sport=65535, dport=80, seq=0xFFFFFFFE):
    ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 0, 0, 0, 64, proto, 0,
                     bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
    tcp = struct.pack("!HHLLBBHHH", sport, dport, seq, 0, (5 + len(options) // 4) << 4, 0, 0, 0, 0)
    return ip + tcp + options + payload


def test_decode_packets(spark):
    raw = [packet(), packet(b"yz", options=b"\x01" * 8), packet(proto=17), packet(b""),
           packet(b"", options=b"\x01" * 4), b"\x45" * 10]
    df = spark.createDataFrame([(START, "n", "eth0", p) for p in raw], schemas.PACKETS)
    got = seg.decode_packets(df).drop("ts").collect()
    assert [(r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.seq, bytes(r.payload)) for r in got] == [
        ("10.200.0.255", 65535, "192.168.1.2", 80, 0xFFFFFFFE, b"x"),
        ("10.200.0.255", 65535, "192.168.1.2", 80, 0xFFFFFFFE, b"yz"),
    ]


def test_port_lists(spark):
    df = spark.createDataFrame([(p, 9) for p in (80, 443, 8443, 22)], "dst_port int, src_port int")
    def kept(ports):
        return sorted(r.dst_port for r in seg.http_port_filter(df, ports).collect())
    assert kept(seg.CAPTURE_PORTS) == [80, 8443]
    assert kept(seg.PACKET_PORTS) == [80, 443, 8443]
    assert kept(seg.RAW_SOCKET_PORTS) == [80]


def test_interfaces(spark):
    rows = [("a", i) for i in ("lo", "eth0", "veth1", "cni0", "wlan0")] + [("b", "lo"), ("b", "wlan0")]
    got = seg.select_interfaces(spark.createDataFrame(rows, "node string, iface string"))
    assert sorted(map(tuple, got.select("node", "iface").collect())) == [
        ("a", "cni0"), ("a", "eth0"), ("a", "veth1"), ("b", "wlan0"),
    ]


def test_parse_and_malformed(spark):
    raw = [
        b"POST /p HTTP/1.1\r\nhost: h\r\nContent-Length: 2\r\n\r\n\xc3\xa9",
        b"HTTP/1.1 200 OK\r\n\r\nall of it",
        b"HTTP/1.1 x\r\n\r\n",
        b"POST /p HTTP/1.1\r\nContent-Length: 9\r\n\r\nshort",
    ]
    df = spark.createDataFrame(
        [("n", "10.0.0.1", 1, "10.0.0.2", 80, START, i, 0, m) for i, m in enumerate(raw)],
        "node string, src_ip string, src_port int, dst_ip string, dst_port int, ts timestamp, "
        "seq bigint, n int, message binary",
    )
    parsed = parse_messages(df)
    first, second = http_records(parsed).orderBy("seq").collect()
    assert (first.type, first.host, first.body) == ("request", "10.0.0.2", "é")
    assert (second.type, second.status_code, second.body) == ("response", 200, "all of it")
    assert malformed(parsed).count() == 2
    relaxed = http_records(parse_messages(df, host_case_sensitive=False))
    assert relaxed.orderBy("seq").first().host == "h"


def test_chunk_of_one_message_is_framed_as_by_the_framer():
    """The short way for a chunk that is one message gives what the framer gives, or leaves the chunk to it."""
    rng = random.Random(11)
    bodies = [b"", b"x" * 7, b"\r\n\r\nGET /in HTTP/1.1\r\n\r\n"]
    starts = [b"GET /a HTTP/1.1", b"POST / HTTP/1.1", b"GET", b"HTTP/1.1 200 OK", b"HTTP/1.1 ok", b"~GET /a"]
    headers = [b"Content-Length: %d", b"content-length:000%d", b"Content-Length: 3%d", b"X: %d",
               b"Content-Length: %d\r\nTransfer-Encoding: chunked"]
    short = 0
    for _ in range(3000):
        body = rng.choice(bodies)
        data = rng.choice(starts) + b"\r\n" + rng.choice(headers) % len(body) + b"\r\n\r\n" + body
        cuts = sorted(rng.sample(range(1, len(data)), rng.randrange(4)))
        pieces = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        rows = []
        for at, piece in enumerate(pieces):
            rows.append((_SEGMENT, 10 * at, at, piece))
            if rng.random() < 0.3:
                rows.append((_SEGMENT, 10 * at + 1, at, piece))
        found = _one_message(rows, 10**6, 10)
        if found is None:
            continue
        short += 1
        framer = Framer()
        framed = [(10 * at, at, *m) for at, piece in enumerate(pieces) for m in framer.feed(piece)]
        assert framed == [found[:4]] and framer.state == FRESH and found[4] == 0
    assert short > 500


def test_long_gaps_and_foreign_rows_are_left_to_the_framer():
    whole = b"GET / HTTP/1.1\r\nContent-Length: 0\r\n\r\n"
    assert _one_message([(_SEGMENT, 0, 1, whole)], 100, 10)[2] == "message"
    assert _one_message([(_SEGMENT, 0, 1, whole[:9]), (_SEGMENT, 101, 2, whole[9:])], 100, 10) is None
    assert _one_message([(_ENTRY, 0, 0, FRESH), (_SEGMENT, 0, 1, whole)], 100, 10) is None
    # the same bytes again, but too late for a copy: a second message
    assert _one_message([(_SEGMENT, 0, 1, whole), (_SEGMENT, 50, 1, whole)], 100, 10) is None


def test_only_flows_with_open_bytes_are_resolved(spark):
    edges = spark.createDataFrame(
        [("a", 1, FRESH, FRESH), ("a", 2, FRESH, FRESH), ("b", 1, FRESH, b"\x00GET"), ("b", 2, FRESH, FRESH),
         ("c", 1, b"\x00GET", FRESH)],
        "flow string, chunk long, entry binary, left binary",
    )
    assert {(r.flow, r.chunk) for r in _open_edges(edges).collect()} == {("b", 1), ("b", 2), ("c", 1)}
