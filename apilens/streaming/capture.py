"""Segments to paired messages as a stream, and continuous storage of records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from operator import attrgetter
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from apilens.functions import http
from apilens.functions.hosts import UNKNOWN, host_label, names_no_service
from apilens.operators.messages import http_records, parse_messages
from apilens.operators.reassembly import FRESH, IDLE_SECONDS, ChunkFramer
from apilens.sources.captures import COMPRESSION, to_capture_records
from apilens.sources.segments import COPY_GAP_SECONDS, FLOW

_OUTPUT = (
    "node string, src_ip string, src_port int, dst_ip string, dst_port int, ts_us bigint, "
    "seq bigint, n int, kind string, message binary, request_head binary"
)
_Out = Row(*(part.split()[0] for part in _OUTPUT.split(", ")))
# Of each connection: its last request head, recent digests, and of both directions when it was seen last, the framer's state
# or how much of a body is still to come, and the number of stored parts of that body.
_SIDE = "last_us bigint, state binary, parts int, node string, src_ip string, src_port int, dst_ip string, dst_port int"
_CONNECTION = (
    "connection string, head binary, head_us bigint, recent binary, "
    f"low struct<{_SIDE.replace(' ', ':').replace(',:', ', ')}>, high struct<{_SIDE.replace(' ', ':').replace(',:', ', ')}>"
)
_COPY_GAP_US = COPY_GAP_SECONDS * 1_000_000
#: Keys of the keyed state.
BUCKETS = 2048
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedup_stream(segments: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop copies of a segment that arrive within the watermark delay of each other.

    Which copy stays is open, so this is for streams that do not go on to be reassembled; those drop
    copies themselves and keep the earliest.
    """
    return segments.withWatermark("ts", delay).dropDuplicatesWithinWatermark(
        [*FLOW, "seq", "payload"]
    )


def _digest(forward: bool, seq: int, payload: bytes) -> bytes:
    return hashlib.blake2b(b"%d %d " % (forward, seq) + payload, digest_size=16).digest()


def _recent(packed: bytes) -> dict[bytes, int]:
    """Digests of the segments seen last, with their latest times."""
    return {packed[a : a + 16]: int.from_bytes(packed[a + 16 : a + 24], "little") for a in range(0, len(packed), 24)}


class _Side:
    """One direction of a connection: a framer, and the stored parts of a body that began in an earlier micro-batch."""

    def __init__(self, flow: tuple, last_us: int | None = None, state: bytes = FRESH, parts: int = 0) -> None:
        self.flow, self.last_us, self.parts, self.state = flow, last_us, parts, state
        self.framer = ChunkFramer(state)

    def row(self) -> tuple:
        return (self.last_us, self.state, self.parts, *self.flow)


class _Connection:
    """What is kept of a connection between micro-batches."""

    def __init__(self, head: bytes | None = None, head_us: int | None = None, recent: bytes = b"", sides: Any = (None, None)):
        self.head, self.head_us, self.packed = head, head_us, recent
        self.sides = {
            forward: _Side(tuple(side[3:]), side[0], bytes(side[1]), side[2])
            for forward, side in zip((True, False), sides, strict=True)
            if side is not None
        }

    @classmethod
    def of(cls, row: Row) -> _Connection:
        return cls(None if row[1] is None else bytes(row[1]), row[2], bytes(row[3]), row[4:6])

    def row(self, name: str) -> tuple:
        low, high = (side and side.row() for side in (self.sides.get(True), self.sides.get(False)))
        return (name, self.head, self.head_us, self.packed, low, high)

    @property
    def last_us(self) -> int:
        return max((side.last_us for side in self.sides.values()), default=0)


class _Assembler(StatefulProcessor):
    """Messages of the connections of one bucket.

    State: a list with one row per connection (last request head, recent digests, both directions), read and written in one
    call each, as a call for every connection costs more than framing it, and a map with the parts of unfinished bodies, which
    are only added to, so a long body is not written again with every micro-batch. A timer drops connections that have
    been silent.
    """

    def __init__(self, idle_us: int) -> None:
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.connections = handle.getListState("connections", _CONNECTION)
        self.bodies = handle.getMapState("bodies", "connection string, forward boolean, part int", "data binary")
        self.timer = handle.getValueState("timer", "timer_ms bigint")

    def _body(self, name: str, forward: bool, side: _Side) -> bytes:
        """Stored parts of the body that has ended now."""
        keys = [(name, forward, part) for part in range(side.parts)]
        whole = b"".join(bytes(self.bodies.getValue(key)[0]) for key in keys)
        for key in keys:
            self.bodies.removeKey(key)
        side.parts = 0
        return whole

    def _open_row(self, name: str, forward: bool, side: _Side) -> Row | None:
        left, origin = side.framer.unfinished()
        left = self._body(name, forward, side) + left
        return _Out(*side.flow, side.last_us, 0, 0, "open", left, None) if left else None

    def _framed(self, name: str, connection: _Connection, rows: list[Row]) -> Iterator[Row]:
        """Frame what a micro-batch has of a connection; its size is set by the source's admission limit."""
        recent, newest, touched = _recent(connection.packed), 0, set()
        for row in sorted(rows, key=attrgetter("ts_us", "order")):
            ts_us, payload, newest = row.ts_us, bytes(row.payload), row.ts_us
            if row.seq is not None:
                digest = _digest(row.forward, row.seq, payload)
                before, recent[digest] = recent.get(digest), ts_us
                if before is not None and ts_us - before <= _COPY_GAP_US:
                    continue
            flow = tuple(row[c] for c in FLOW)
            touched.add(row.forward)
            side = connection.sides.setdefault(row.forward, _Side(flow))
            if side.last_us is not None and ts_us - side.last_us > self.idle_us:
                # the port serves another connection now
                opened = self._open_row(name, row.forward, side)
                if opened:
                    yield opened
                side = connection.sides[row.forward] = _Side(flow)
            side.last_us = ts_us
            for n, (kind, data, origin) in enumerate(side.framer.feed(payload)):
                if origin is not None:
                    data = self._body(name, row.forward, side) + data
                is_response = data.startswith(b"HTTP/")
                if kind == "message" and not is_response:
                    connection.head, connection.head_us = data[: data.find(b"\r\n\r\n") + 4], ts_us
                elif connection.head_us is not None and ts_us - connection.head_us > self.idle_us:
                    connection.head = connection.head_us = None
                yield _Out(*flow, ts_us, row.seq or 0, n, kind, data, connection.head if is_response else None)
        for forward in touched:
            side = connection.sides[forward]
            side.state, part = side.framer.leave(0)
            part = part if part is not None else b"".join(side.framer.head) if side.framer.skip else None
            if part:
                self.bodies.updateValue((name, forward, side.parts), (part,))
                side.parts += 1
        connection.packed = b"".join(
            d + us.to_bytes(8, "little") for d, us in recent.items() if newest - us <= _COPY_GAP_US
        )

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        given: dict[str, list[Row]] = {}
        for row in rows:
            given.setdefault(row.connection, []).append(row)
        kept = {r[0]: _Connection.of(r) for r in self.connections.get()}
        for name, some in given.items():
            yield from self._framed(name, kept.setdefault(name, _Connection()), some)
        self.connections.put([connection.row(name) for name, connection in kept.items()])
        if self.timer.get() is None:
            earliest = min(connection.last_us for connection in kept.values()) // 1000
            self._set_timer(max(earliest, timerValues.getCurrentWatermarkInMs()) + self.idle_us // 1000)

    def _set_timer(self, timer_ms: int) -> None:
        self.timer.update((timer_ms,))
        self.handle.registerTimer(timer_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        watermark, idle_ms = timerValues.getCurrentWatermarkInMs(), self.idle_us // 1000
        kept, due = [], None
        for row in list(self.connections.get()):
            connection = _Connection.of(row)
            ends = connection.last_us // 1000 + idle_ms
            if ends > watermark:
                kept.append(connection.row(row[0]))
                due = ends if due is None else min(due, ends)
                continue
            for forward, side in connection.sides.items():
                opened = self._open_row(row[0], forward, side)
                if opened:
                    yield opened
        self.connections.clear()
        self.timer.clear()
        if kept:
            self.connections.put(kept)
            self._set_timer(due)

    def close(self) -> None:
        pass


def assemble_stream(
    segments: DataFrame, delay: str = "10 minutes", idle_seconds: int = IDLE_SECONDS, buckets: int = BUCKETS
) -> DataFrame:
    """Whole messages of a segment stream; responses come with the head of their request.

    Copies of segments are dropped as in the batch plan, also if they come in different micro-batches. A
    direction that goes on after a silence of more than ``idle_seconds`` starts anew, and what it had begun
    comes out with kind ``open``.

    Connections are dealt into ``buckets``, the keys of the state, and a bucket's part of a micro-batch is one call: the number
    belongs to the checkpoint and must not change, and bounds the tasks that can work at once. State per connection: the open bytes of both directions and the last request head. It is
    dropped, and its open bytes come out with kind ``open``, once the watermark has passed the connection's last
    segment by ``idle_seconds``, so connections that fall silent do not pile up. Segments have to arrive in
    capture order, apart from the order inside a micro-batch. Flows whose columns are partly null are flows like others.

    The operator needs the RocksDB state store, which this switches on for the session.
    """
    segments.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)

    def end(ip: str, port: str) -> Column:
        return F.concat_ws(":", F.coalesce(ip, F.lit("-")), F.coalesce(F.col(port).cast("string"), F.lit("-")))

    low, high = end("src_ip", "src_port"), end("dst_ip", "dst_port")
    keyed = (
        segments.withWatermark("ts", delay)
        .select("ts", F.unix_micros("ts").alias("ts_us"), *FLOW, "seq", "payload")
        .withColumn("order", F.coalesce("seq", F.lit(0).cast("bigint")))
        .withColumn("forward", low < high)
        .withColumn(
            "connection", F.concat_ws("|", F.coalesce("node", F.lit("-")), F.least(low, high), F.greatest(low, high))
        )
    )
    dealt = keyed.withColumn("bucket", F.pmod(F.xxhash64("connection"), F.lit(buckets)))
    assembled = dealt.groupBy("bucket").transformWithState(
        _Assembler(idle_seconds * 1_000_000), _OUTPUT, "append", "eventTime"
    )
    return assembled.withColumn("ts", F.timestamp_micros("ts_us")).drop("ts_us")


def paired_records(assembled: DataFrame, directory: DataFrame) -> DataFrame:
    """Records with service and request fields; a stateless plan, so it runs on batch and stream."""
    head = http.header_text(F.col("request_head"))
    line = http.request_line(http.start_line(head))
    messages = assembled.filter("kind = 'message'")
    requests = messages.select(
        "*",
        line["method"].alias("request_method"),
        line["path"].alias("request_endpoint"),
        F.when(
            line.isNotNull(), http.host_of(http.header_map(http.header_pairs(head)), F.col("src_ip"))
        ).alias("request_host"),
    )
    extra = ["request_method", "request_endpoint", "request_host"]
    parsed = http_records(parse_messages(requests, keep=extra))
    is_request = F.col("type") == "request"

    def taken(own: str, other: str, default: Column) -> Column:
        return F.when(is_request, F.col(own)).otherwise(F.coalesce(F.col(other), default))

    paired = parsed.select(
        *[c for c in parsed.columns if c not in {*extra, "method", "endpoint", "host"}],
        taken("method", "request_method", F.lit("UNKNOWN")).alias("method"),
        taken("endpoint", "request_endpoint", F.lit("/")).alias("endpoint"),
        taken("host", "request_host", F.col("destination_ip")).alias("host"),
        # The address to look up is the server's: a paired response comes from it.
        F.when(
            ~is_request & F.col("request_host").isNotNull(), F.col("source_ip")
        ).otherwise(F.col("destination_ip")).alias("server_ip"),
    )
    return (
        paired.join(directory.withColumnRenamed("ip", "server_ip"), "server_ip", "left")
        .withColumn(
            "service",
            F.when(
                names_no_service(F.col("host")), F.coalesce("ip_service", F.lit(UNKNOWN))
            ).otherwise(host_label(F.col("host"))),
        )
        .drop("server_ip", "ip_service")
    )


def store_captures(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append canonical records to a capture folder as they come."""
    return (
        to_capture_records(messages)
        .writeStream.format("json")
        .option("path", path)
        .option("compression", COMPRESSION)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
