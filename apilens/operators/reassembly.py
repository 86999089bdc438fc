"""TCP segments to whole HTTP messages.

A flow (one direction of a connection on one node) can hold a large share of all traffic, so it is
never handled as one group. Flows are cut into time chunks, every chunk is framed on its own, and
what was left open at the end of a chunk is handed to the next one:

1. Shuffle by (flow, chunk), sort inside partitions, and frame all chunks in one streaming pass
   (``mapInArrow``; a task holds one unfinished message, never a group). The same pass drops copies of
   segments. Each chunk is assumed to start at a message boundary. The output is written once.
2. One row per chunk - how many bytes it has, what it was given, what it left - is read in the order of each flow,
   for the flows that leave something open in some chunk.
   A body that goes on behind its chunk leaves a number of bytes still to come, not bytes: summed up
   over the chunks behind, that number says in which chunk the body ends, and the chunks before that one
   belong to it whole. Where a head is open its bytes are handed on.
3. A chunk is stale when it was given something else than it should have been. Only stale chunks are
   framed again. This repeats until nothing is stale: after round k the first k chunks of every flow
   that were framed again are final, so it always ends. Framing finds its place again after one message and
   bodies are skipped by length, so one or two rounds do, however many chunks a body spans.
4. Messages over several chunks are put together from their parts, which only those chunks are read for.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apilens.functions.http import METHODS, UNREACHABLE_LENGTH
from apilens.sources.segments import FLOW, non_empty
from apilens.staging import staged

_HEADS = tuple(name.encode() for name in METHODS) + (b"HTTP/",)
_LONGEST_HEAD = max(map(len, _HEADS))
# Where a message can begin after lost or foreign bytes.
_RESTART = re.compile(
    rb"(?:" + b"|".join(_HEADS[:-1]) + rb") (?:/|\*|http)|HTTP/[0-9]\.[0-9] [0-9]"
)
_LONGEST_RESTART = 12
# The rule of apilens.functions.http.LENGTH_HEADER on bytes.
_LENGTH = re.compile(rb"(?i)\r\n[ \t]*content-length[ \t]*:[ \t]*0*([0-9]+)[ \t]*(?=\r\n|\Z)")
_CHUNKED = re.compile(rb"(?i)\r\n[ \t]*transfer-encoding[ \t]*:[^\r\n]*chunked[ \t]*(?=\r\n|\Z)")
_CHUNK_SIZE = re.compile(rb"[ \t]*([0-9a-fA-F]+)[ \t]*(?:;[^\r\n]*)?\Z")
_LONGEST_SIZE_LINE = 4096
_CODE = re.compile(rb"^\S+\s+[0-9]+(?:\s|$)")

FRESH = b"\x00"
# State of a chunk that begins inside a body: bytes still to come, chunk of its head, whether the start line is one.
_INSIDE = b"\x02"
_SPAN = struct.Struct("<qq?")


class Framer:
    """Cuts the bytes of one flow into messages; the state is the bytes not yet used.

    A message ends after its Content-Length, or after its last chunk if it is sent in chunks; chunks leave as
    one plain body. Without either it ends with the segment that completed its headers, unless a further
    message starts right there. Bytes that start no message are dropped up to the next place where one can
    start.
    """

    def __init__(self, state: bytes = FRESH):
        self.lost = state[:1] != FRESH
        self.open = bytearray(state[1:])
        self.need = 0
        self.scanned = 0
        self.body_of: bool | None = None
        self._restart_chunks()

    def _restart_chunks(self) -> None:
        # the end of the chunks that are complete, and where their content lies
        self.chunk_at = 0
        self.content: list[tuple[int, int]] = []

    @property
    def state(self) -> bytes:
        return (b"\x01" if self.lost else FRESH) + bytes(self.open)

    def _take(self, count: int) -> bytes:
        piece = bytes(self.open[:count])
        del self.open[:count]
        self.need = self.scanned = 0
        self.body_of = None
        self._restart_chunks()
        return piece

    def _chunks(self, body: int) -> int | None:
        """Where a body in chunks ends, -1 if it is no such body, None while it is open."""
        at = self.chunk_at or body
        while True:
            end = self.open.find(b"\r\n", at)
            if end < 0:
                self.chunk_at = at
                return -1 if len(self.open) - at > _LONGEST_SIZE_LINE else None
            size = _CHUNK_SIZE.match(bytes(self.open[at:end]))
            if size is None or len(size.group(1).lstrip(b"0")) > 15:
                return -1
            length = int(size.group(1), 16)
            if not length:
                # trailer lines up to an empty one
                if self.open.startswith(b"\r\n", end + 2):
                    return end + 4
                last = self.open.find(b"\r\n\r\n", end + 2)
                self.chunk_at = at
                return last + 4 if last >= 0 else None
            following = end + 2 + length + 2
            if len(self.open) < following:
                self.chunk_at, self.need = at, following
                return None
            if self.open[following - 2 : following] != b"\r\n":
                return -1
            self.content.append((end + 2, following - 2))
            at = following

    def _plain(self, head_end: int) -> bytes:
        return bytes(self.open[:head_end]) + b"".join(self.open[a:b] for a, b in self.content)

    def feed(self, payload: bytes) -> Iterator[tuple[str, bytes]]:
        """Add one segment; yields ('message' | 'reject', bytes)."""
        self.open += payload
        while self.open and len(self.open) >= self.need:
            if not self.lost and not self.open.startswith(_HEADS):
                if len(self.open) < _LONGEST_HEAD and any(
                    head.startswith(self.open) for head in _HEADS
                ):
                    return
                self.lost = True
            if self.lost:
                found = _RESTART.search(self.open)
                if found is None:
                    # Keep what may be the first part of a start.
                    if len(self.open) >= _LONGEST_RESTART:
                        yield "reject", self._take(len(self.open) - _LONGEST_RESTART + 1)
                    return
                if found.start():
                    yield "reject", self._take(found.start())
                self.lost = False
            end = self.open.find(b"\r\n\r\n", self.scanned)
            if end < 0:
                self.scanned = max(0, len(self.open) - 3)
                return
            head = bytes(self.open[:end])
            first = head.split(b"\r\n", 1)[0]
            whole = _CODE.match(first) if head.startswith(b"HTTP/") else len(first.split()) >= 2
            length = _LENGTH.search(head)
            if _CHUNKED.search(head):
                total = self._chunks(end + 4)
                if total is None:
                    self.scanned = end
                    return
                if total >= 0:
                    plain = self._plain(end + 4)
                    self._take(total)
                    yield ("message" if whole else "reject"), plain
                    continue
                self._restart_chunks()
            if length:
                digits = length.group(1)
                self.need = end + 4 + (UNREACHABLE_LENGTH if len(digits) > 18 else int(digits))
                if len(self.open) < self.need:
                    self.scanned = end
                    self.body_of = bool(whole)
                    return
                total = self.need
            elif _RESTART.match(self.open, end + 4):
                total = end + 4
            else:
                total = len(self.open)
            yield ("message" if whole else "reject"), self._take(total)


class ChunkFramer:
    """Frames a chunk from what it was given: a framer's state, or a body to skip first."""

    def __init__(self, entry: bytes = FRESH):
        self.skip, self.origin, self.whole = 0, None, True
        self.head: list[bytes] = []
        if entry.startswith(_INSIDE):
            self.skip, self.origin, self.whole = _SPAN.unpack(entry[1:])
            entry = FRESH
        self.framer = Framer(entry)

    def feed(self, payload: bytes) -> Iterator[tuple[str, bytes, int | None]]:
        """As the framer, with the chunk in which a message began whose first part is not here."""
        if self.skip:
            taken = payload[: self.skip]
            self.head.append(taken)
            self.skip -= len(taken)
            if self.skip:
                return
            yield ("message" if self.whole else "reject"), b"".join(self.head), self.origin
            payload = payload[len(taken) :]
            if not payload:
                return
        for kind, data in self.framer.feed(payload):
            yield kind, data, None

    def unfinished(self) -> tuple[bytes, int | None]:
        return (b"".join(self.head), self.origin) if self.skip else (self.framer.state[1:], None)

    def leave(self, chunk: int) -> tuple[bytes, bytes | None]:
        """(what the next chunk is given, the first part of a body that goes on there)."""
        if self.skip:
            return _INSIDE + _SPAN.pack(self.skip, self.origin, self.whole), None
        if self.framer.body_of is None:
            return self.framer.state, None
        opened = bytes(self.framer.open)
        return _INSIDE + _SPAN.pack(self.framer.need - len(opened), chunk, self.framer.body_of), opened


class _Copies:
    """Recognises segments that were seen within the gap, by seq and digest."""

    def __init__(self, gap_us: int) -> None:
        self.gap_us = gap_us
        self.seen: dict[tuple[int, bytes], int] = {}
        self.room = 1 << 14

    def is_copy(self, seq: int, digest: bytes, ts_us: int) -> bool:
        before = self.seen.get((seq, digest))
        self.seen[seq, digest] = ts_us
        if len(self.seen) > self.room:
            self.seen = {k: us for k, us in self.seen.items() if ts_us - us <= self.gap_us}
            self.room = max(1 << 14, 2 * len(self.seen))
        return before is not None and ts_us - before <= self.gap_us


_ENTRY, _CONTEXT, _SEGMENT = 0, 1, 2

_FRAMED = (
    "flow string, chunk bigint, ts_us bigint, seq bigint, n int, kind string, data binary, "
    "entry binary, first_us bigint, bytes bigint, silence boolean, origin bigint, left binary"
)
_FRAMED_ARROW = pa.schema(
    [
        ("flow", pa.string()),
        ("chunk", pa.int64()),
        ("ts_us", pa.int64()),
        ("seq", pa.int64()),
        ("n", pa.int32()),
        ("kind", pa.string()),
        ("data", pa.binary()),
        ("entry", pa.binary()),
        ("first_us", pa.int64()),
        ("bytes", pa.int64()),
        ("silence", pa.bool_()),
        ("origin", pa.int64()),
        ("left", pa.binary()),
    ]
)
_BATCH_BYTES = 16 << 20


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


_Place = tuple[str, int]
_Segment = tuple[int, int, int | None, bytes]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Place, list[_Segment], bool]]:
    """((flow, chunk), rows (role, ts_us, seq, payload), whether these are all rows of the chunk), in order."""
    held: tuple[_Place, list[_Segment], bool] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        flows, chunks, *values = (
            batch.column(name).to_pylist() for name in ("flow", "chunk", "role", "ts_us", "seq", "payload")
        )
        rows = list(zip(*values, strict=True))
        starts = [0, *(i for i in range(1, len(rows)) if chunks[i] != chunks[i - 1] or flows[i] != flows[i - 1])]
        for at, end in zip(starts, [*starts[1:], len(rows)], strict=True):
            place = (flows[at], chunks[at])
            cut = held is not None and held[0] == place
            if held is not None:
                yield held[0], held[1], held[2] and not cut
            held = place, rows[at:end], not cut
    if held is not None:
        yield held


def _without_copies(rows: list[_Segment], copies: _Copies, gap_us: int | None) -> Iterator[_Segment]:
    """Entries, and segments that are no copies."""
    for role, ts_us, seq, payload in rows:
        if role != _ENTRY and gap_us is not None and seq is not None:
            digest = payload if role == _CONTEXT else hashlib.md5(payload).digest()
            if copies.is_copy(seq, digest, ts_us):
                continue
        if role != _CONTEXT:
            yield role, ts_us, seq or 0, payload


def _segments_in_order(
    batches: Iterator[pa.RecordBatch], gap_us: int | None
) -> Iterator[tuple[_Place, int, int, int, bytes]]:
    """((flow, chunk), role, ts_us, seq, payload) of entries and of segments that are no copies."""
    key, copies = None, _Copies(gap_us or 0)
    for place, rows, _ in _runs(batches):
        if place != key:
            key, copies = place, _Copies(gap_us or 0)
        for segment in _without_copies(rows, copies, gap_us):
            yield place, *segment


def _one_message(rows: list[_Segment], idle_us: int, gap_us: int | None) -> tuple | None:
    """(ts_us, seq, kind, message, first_us) if a whole chunk is exactly one message of announced length, as most are.

    A framer would give the same: the message is complete with its last byte, so with the last segment.
    """
    first, last = rows[0], rows[-1]
    if first[0] != _SEGMENT or last[1] - first[1] > idle_us:
        return None
    if len(rows) == 1:
        kept = rows
    elif gap_us is None:
        kept = rows
    else:
        seen: dict[tuple[int, bytes], int] = {}
        kept = []
        for row in rows:
            _, ts_us, seq, payload = row
            if seq is not None:
                before = seen.get((seq, payload))
                seen[seq, payload] = ts_us
                if before is not None and ts_us - before <= gap_us:
                    continue
            kept.append(row)
        last = kept[-1]
    data = kept[0][3] if len(kept) == 1 else b"".join([row[3] for row in kept])
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(_HEADS):
        return None
    head = data[:end]
    length = _LENGTH.search(head)
    if length is None or len(length.group(1)) > 18 or end + 4 + int(length.group(1)) != len(data):
        return None
    if b"transfer-encoding" in head.lower():
        return None
    start = head.split(b"\r\n", 1)[0]
    whole = _CODE.match(start) if start.startswith(b"HTTP/") else len(start.split()) >= 2
    return last[1], last[2] or 0, "message" if whole else "reject", data, first[1]


def _frame_sorted(
    batches: Iterator[pa.RecordBatch], idle_us: int, gap_us: int | None
) -> Iterator[pa.RecordBatch]:
    """Frame a partition sorted by (flow, chunk, role, arrival); one chunk's state at a time.

    After a silence of more than ``idle_us`` inside a chunk the flow starts anew.
    """
    rows: list[tuple] = []
    size = 0
    key, copies, framer, entry, first, last, total, silence = None, None, None, FRESH, None, (0, 0), 0, False
    none = (None,) * 6

    def edge() -> None:
        left, part = framer.leave(key[1])
        if part is not None:
            rows.append((*key, *last, 0, "part", part, *none))
        rows.append((*key, *last, 0, "edge", None, entry, first, total, silence, None, left))

    for place, run, complete in _runs(batches):
        if place != key:
            if framer is not None:
                edge()
            key, framer = place, None
            found = _one_message(run, idle_us, gap_us) if complete else None
            if found is None:
                copies = _Copies(gap_us or 0)
            else:
                ts_us, seq, kind, data, first_us = found
                rows.append((*place, ts_us, seq, 0, kind, data, *none))
                rows.append((*place, ts_us, seq, 0, "edge", None, FRESH, first_us, len(data), False, None, FRESH))
                size += len(data)
                run = []
        for role, ts_us, seq, payload in _without_copies(run, copies, gap_us):
            if framer is None:
                framer, entry, first, last, total, silence = ChunkFramer(), FRESH, None, (0, 0), 0, False
            if first is not None and role == _SEGMENT and place[1] != _BEFORE_ALL and ts_us - last[0] > idle_us:
                unfinished, origin = framer.unfinished()
                if unfinished or origin is not None:
                    rows.append((*key, last[0], 0, 0, "open", unfinished, None, None, None, None, origin, None))
                framer, silence = ChunkFramer(), True
            last = max(last, (ts_us, seq))
            if role == _ENTRY:
                framer, entry = ChunkFramer(payload), payload
                first = ts_us if place[1] == _BEFORE_ALL else first
                continue
            first = ts_us if first is None else first
            total += len(payload)
            for n, (kind, data, origin) in enumerate(framer.feed(payload)):
                rows.append((*place, ts_us, seq, n, kind, data, None, None, None, None, origin, None))
                size += len(data)
            if size > _BATCH_BYTES:
                yield _arrow(rows, _FRAMED_ARROW)
                rows, size = [], 0
        if size > _BATCH_BYTES or len(rows) >= 10_000:
            yield _arrow(rows, _FRAMED_ARROW)
            rows, size = [], 0
    if framer is not None:
        edge()
    if rows:
        yield _arrow(rows, _FRAMED_ARROW)


def _dealt(keyed: DataFrame) -> DataFrame:
    """The one shuffle of payloads. Sorted by a hash first: it tells most flows apart, whose names begin alike."""
    return keyed.repartition("flow", "chunk").sortWithinPartitions(
        F.xxhash64("flow", "chunk"), "flow", "chunk", "role", "ts_us", "seq", "payload"
    )


def _frame(keyed: DataFrame, idle_us: int, gap_us: int | None) -> DataFrame:
    return _dealt(keyed).mapInArrow(
        functools.partial(_frame_sorted, idle_us=idle_us, gap_us=gap_us), _FRAMED
    )


_MARKS = "flow string, chunk bigint, status string, entry binary, before bigint, origin bigint, ts_us bigint"
_MARKS_ARROW = pa.schema(
    [
        ("flow", pa.string()),
        ("chunk", pa.int64()),
        ("status", pa.string()),
        ("entry", pa.binary()),
        ("before", pa.int64()),
        ("origin", pa.int64()),
        ("ts_us", pa.int64()),
    ]
)
_FRESH_MARK = hashlib.sha256(FRESH).digest()


def _resolve_sorted(batches: Iterator[pa.RecordBatch], idle_us: int) -> Iterator[pa.RecordBatch]:
    """Read the edges of each flow in order; one number or digest is carried along.

    Rows: ``stale`` chunks with what they should be given (``entry``, or what the chunk ``before`` left),
    ``swallowed`` chunks that lie inside the body begun in ``origin``, ``spanned`` chunks that a body reaches into,
    and what is open where a flow falls silent (``closed``) or ends (``left``).
    """
    rows: list[tuple] = []
    flow, given, source, last_us = None, _FRESH_MARK, None, 0

    def ends(status: str) -> None:
        if given.startswith(_INSIDE) and len(given) == 1 + _SPAN.size:
            rows.append((flow, source, status, None, None, _SPAN.unpack(given[1:])[1], last_us))
        elif given != _FRESH_MARK:
            rows.append((flow, source, status, None, source, None, last_us))

    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in
                   ("flow", "chunk", "first_us", "ts_us", "left", "used", "bytes", "silence")]
        for name, chunk, first_us, ts_us, left, used, count, silence in zip(*columns, strict=True):
            if name != flow:
                if flow is not None:
                    ends("left")
                flow = name
            else:
                if first_us - last_us > idle_us:
                    ends("closed")
                    given = _FRESH_MARK
                if given.startswith(_INSIDE) and len(given) == 1 + _SPAN.size:
                    skip, origin, whole = _SPAN.unpack(given[1:])
                    if skip > count and not silence:
                        rows.append((flow, chunk, "swallowed", None, None, origin, ts_us))
                        given = _INSIDE + _SPAN.pack(skip - count, origin, whole)
                        last_us = ts_us
                        continue
                    entry, before = given, None
                    rows.append((flow, chunk, "spanned", None, None, None, ts_us))
                elif given == _FRESH_MARK:
                    entry, before = FRESH, None
                else:
                    entry, before = None, source
                if used != given:
                    rows.append((flow, chunk, "stale", entry, before, None, ts_us))
            given, source, last_us = left, chunk, ts_us
            if len(rows) >= 10_000:
                yield _arrow(rows, _MARKS_ARROW)
                rows.clear()
    if flow is not None:
        ends("left")
    if rows:
        yield _arrow(rows, _MARKS_ARROW)


def _open_edges(edges: DataFrame) -> DataFrame:
    """The edges of flows that leave something open somewhere, or go on with it; all others have no marks."""
    is_open = (F.col("left") != F.lit(FRESH)) | (F.col("entry") != F.lit(FRESH))
    flows = staged(edges.filter(is_open).select("flow").distinct(), "open-flows")
    return edges.join(flows, "flow", "left_semi")


def _resolve(edges: DataFrame, idle_us: int) -> DataFrame:
    """Marks of all chunks. Open bytes are compared by digest and never leave their row."""

    def mark(state: str) -> Column:
        inside = F.substring(state, 1, 1) == F.lit(_INSIDE)
        return F.when(inside, F.col(state)).otherwise(F.unhex(F.sha2(F.col(state), 256)))

    narrow = edges.select(
        "flow", "chunk", "first_us", "ts_us", mark("left").alias("left"), mark("entry").alias("used"), "bytes", "silence"
    )
    return (
        narrow.repartition("flow")
        .sortWithinPartitions("flow", "chunk")
        .mapInArrow(functools.partial(_resolve_sorted, idle_us=idle_us), _MARKS)
    )


_PARTS = "flow string, origin bigint, place bigint, at bigint, ts_us bigint, seq bigint, n int, kind string, data binary"
_WHOLE = "flow string, ts_us bigint, seq bigint, n int, kind string, data binary"
_WHOLE_ARROW = pa.schema(
    [
        ("flow", pa.string()),
        ("ts_us", pa.int64()),
        ("seq", pa.int64()),
        ("n", pa.int32()),
        ("kind", pa.string()),
        ("data", pa.binary()),
    ]
)
_LAST_PLACE = 1 << 62


def _collect_sorted(batches: Iterator[pa.RecordBatch], gap_us: int | None) -> Iterator[pa.RecordBatch]:
    """The bytes of whole chunks, in pieces of bounded size."""
    schema = pa.schema([("flow", pa.string()), ("chunk", pa.int64()), ("at", pa.int64()), ("data", pa.binary())])
    key, held, size, at = None, [], 0, 0

    def piece() -> pa.RecordBatch:
        return _arrow([(*key, at, b"".join(held))], schema)

    for place, _, _, _, payload in _segments_in_order(batches, gap_us):
        if place != key or size > _BATCH_BYTES:
            if held:
                yield piece()
            at = 0 if place != key else at + 1
            key, held, size = place, [], 0
        held.append(payload)
        size += len(payload)
    if held:
        yield piece()


def _join_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put parts together; the last part of a message carries what is known of it."""
    key, held = None, []
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in
                   ("flow", "origin", "ts_us", "seq", "n", "kind", "data")]
        for flow, origin, ts_us, seq, n, kind, data in zip(*columns, strict=True):
            if (flow, origin) != key:
                key, held = (flow, origin), []
            held.append(data)
            if kind is not None:
                yield _arrow([(flow, ts_us, seq, n, kind, b"".join(held))], _WHOLE_ARROW)
                held = []


def _joined(
    result: DataFrame, marks: DataFrame, keyed: DataFrame, gap_us: int | None, any_swallowed: bool
) -> DataFrame:
    """(flow, ts_us, seq, n, kind, data) of what spans chunks; kind ``left`` where a flow ends inside a body."""
    spark = result.sparkSession
    first = result.filter("kind = 'part'").selectExpr(
        "flow", "chunk as origin", "chunk as place", "0L as at", "null as ts_us", "null as seq", "null as n",
        "null as kind", "data",
    )
    last = result.filter("origin IS NOT NULL").selectExpr(
        "flow", "origin", f"{_LAST_PLACE}L as place", "0L as at", "ts_us", "seq", "n", "kind", "data"
    )
    ends = marks.filter("status IN ('closed', 'left') AND origin IS NOT NULL").selectExpr(
        "flow", "origin", f"{_LAST_PLACE}L as place", "0L as at", "ts_us", "0L as seq", "0 as n",
        "if(status = 'left', 'left', 'open') as kind", "X'' as data",
    )
    parts = spark.createDataFrame([], _PARTS).union(first).union(last).union(ends)
    swallowed = marks.filter("status = 'swallowed'").select("flow", "chunk", "origin")
    if any_swallowed:
        inner = _dealt(keyed.join(swallowed.select("flow", "chunk"), ["flow", "chunk"], "left_semi")).mapInArrow(
            functools.partial(_collect_sorted, gap_us=gap_us), "flow string, chunk bigint, at bigint, data binary"
        )
        parts = parts.union(
            inner.join(swallowed, ["flow", "chunk"]).selectExpr(
                "flow", "origin", "chunk as place", "at", "null as ts_us", "null as seq", "null as n", "null as kind", "data"
            )
        )
    return (
        parts.repartition("flow", "origin")
        .sortWithinPartitions("flow", "origin", "place", "at")
        .mapInArrow(_join_sorted, _WHOLE)
    )


# Segments seen last, by the MD5 of their payload: what later ones can be copies of.
RECENT = (
    "node string, src_ip string, src_port int, dst_ip string, dst_port int, seq bigint, "
    "digest string, last_us bigint"
)
# Flows with unused bytes: what is left over after one batch of segments and opens the next.
OPEN_FLOWS = "flow string, ts_us bigint, state binary"
_BEFORE_ALL = -(1 << 62)


# Silence after which a flow starts anew, in batch plans and in streams.
IDLE_SECONDS = 600


def reassemble(
    segments: DataFrame,
    chunk: str = "1 minute",
    idle_seconds: int = IDLE_SECONDS,
    copy_gap_seconds: int | None = None,
) -> DataFrame:
    """Whole messages, rejected bytes and unfinished messages of all flows.

    Input: :data:`apilens.schemas.SEGMENTS`. Output: the flow columns,
    ``ts`` and ``seq`` of the completing segment, ``n`` (ordinal inside that segment), ``kind``
    (``message``, ``reject`` or ``open``) and ``data``. ``chunk`` is the length of a time chunk: it bounds
    the part of a flow that one task handles and has no influence on the result. A flow that is silent for
    more than ``idle_seconds`` starts anew, as its port may serve another connection then; what it had
    begun comes out as ``open``, and so does what is unfinished at the end.

    With ``copy_gap_seconds`` copies of segments are dropped on the way, by the rule of
    :func:`apilens.sources.segments.dedup_segments` but without its shuffle; chunks are at least that long
    then. Without it there must not be any.

    This is a job, not only a plan: the rounds run before it returns.
    """
    framed, left = reassemble_onto(segments, None, chunk, idle_seconds, copy_gap_seconds)
    return framed.unionByName(_opened(left.select("flow", "ts_us", F.col("state").alias("data"))))


def _opened(flows: DataFrame) -> DataFrame:
    """Unfinished bytes (flow, ts_us, data as a framer's state) as rows of the result."""
    bytes_only = F.substr("data", F.lit(2))
    rows = flows.select(
        "flow", "ts_us", F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("n"), F.lit("open").alias("kind"),
        bytes_only.alias("data"),
    )
    return _named(rows.filter(F.length("data") > 0))


def flow_columns(rows: DataFrame) -> DataFrame:
    """The columns that the key ``flow`` was made of, ``ts`` from ``ts_us``, and all other columns."""
    part = [F.nullif(p, F.lit(_NULL)) for p in (F.get(F.split("flow", r"\|"), i) for i in range(len(FLOW)))]
    typed = [p.cast("int") if name.endswith("port") else p for name, p in zip(FLOW, part, strict=True)]
    others = [c for c in rows.columns if c not in ("flow", "ts_us")]
    return rows.select(
        *(p.alias(name) for name, p in zip(FLOW, typed, strict=True)), F.timestamp_micros("ts_us").alias("ts"), *others
    )


def _named(rows: DataFrame) -> DataFrame:
    return flow_columns(rows).select(*FLOW, "ts", "seq", "n", "kind", "data")


# Stands for a missing part of a flow's key.
_NULL = "-"


def _flow() -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(name).cast("string"), F.lit(_NULL)) for name in FLOW))


def _keyed(segments: DataFrame, width_us: int, gap_us: int | None) -> DataFrame:
    """Segments with flow and chunk. To recognise copies across a border, the digests of the last segments of a chunk
    go to the chunk behind as well."""
    ts_us = F.unix_micros("ts")
    chunk = F.floor(ts_us / F.lit(width_us)).cast("bigint")
    rows = non_empty(segments).select(_flow().alias("flow"), chunk.alias("own"), ts_us.alias("ts_us"), "seq", "payload")
    segment = F.struct(F.col("own").alias("chunk"), F.lit(_SEGMENT).alias("role"), F.col("payload").alias("payload"))
    if gap_us is None:
        return rows.select("flow", "own", "ts_us", "seq", "payload").selectExpr(
            "flow", "own as chunk", f"{_SEGMENT} as role", "ts_us", "seq", "payload"
        )
    digest = F.unhex(F.md5("payload"))
    context = F.struct(
        (F.col("own") + 1).alias("chunk"), F.lit(_CONTEXT).alias("role"), digest.alias("payload")
    )
    border = F.col("seq").isNotNull() & (F.col("ts_us") + gap_us >= (F.col("own") + 1) * width_us)
    both = F.when(border, F.array(segment, context)).otherwise(F.array(segment))
    return rows.select("flow", "ts_us", "seq", F.inline(both)).select(
        "flow", "chunk", "role", "ts_us", "seq", "payload"
    )


def reassemble_onto(
    segments: DataFrame,
    open_flows: DataFrame | None,
    chunk: str = "1 minute",
    idle_seconds: int = IDLE_SECONDS,
    copy_gap_seconds: int | None = None,
    recent: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Like :func:`reassemble`, for segments that continue ``open_flows`` (:data:`OPEN_FLOWS`).

    Returns the messages and the flows that are open afterwards. What a flow had open counts as a
    chunk before all others. ``recent`` (:data:`RECENT`) are earlier segments that these may be copies of.
    """
    idle_us = idle_seconds * 1_000_000
    gap_us = None if copy_gap_seconds is None else copy_gap_seconds * 1_000_000
    width_us = _microseconds(chunk)
    if gap_us is not None and width_us < gap_us:
        raise ValueError("a chunk is at least as long as the copy gap")
    keyed = _keyed(segments, width_us, gap_us)
    none = F.lit(0).cast("bigint")
    if open_flows is not None:
        keyed = keyed.unionByName(
            open_flows.select(
                "flow",
                F.lit(_BEFORE_ALL).cast("bigint").alias("chunk"),
                F.lit(_ENTRY).alias("role"),
                "ts_us",
                none.alias("seq"),
                F.col("state").alias("payload"),
            )
        )
    if recent is not None:
        own = F.floor(F.col("last_us") / F.lit(width_us)).cast("bigint")
        known = recent.select(_flow().alias("flow"), F.col("last_us").alias("ts_us"), "seq", F.unhex("digest").alias("payload"), F.explode(F.array(own, own + 1)).alias("chunk"))
        keyed = keyed.unionByName(known.withColumn("role", F.lit(_CONTEXT)))
    rounds = [staged(_frame(keyed, idle_us, gap_us).withColumn("round", F.lit(0)), "framed")]
    edges = rounds[0].filter("kind = 'edge'")
    replaced = None
    while True:
        marks = staged(_resolve(_open_edges(edges), idle_us), "marks")
        stale = marks.filter("status = 'stale'")
        seen = marks.agg(
            F.bool_or(F.col("status") == "stale").alias("stale"),
            F.bool_or(F.col("status") == "swallowed").alias("swallowed"),
            F.bool_or((F.col("status") == "spanned") | F.col("origin").isNotNull()).alias("spanned"),
        ).first()
        if not seen.stale:
            break
        names = stale.select("flow", "chunk")
        exits = edges.select("flow", F.col("chunk").alias("before"), F.col("left").alias("exit"))
        carried = stale.join(exits, ["flow", "before"], "left").select(
            "flow",
            "chunk",
            F.lit(_ENTRY).alias("role"),
            none.alias("ts_us"),
            none.alias("seq"),
            F.coalesce("entry", "exit").alias("payload"),
        )
        again = keyed.join(names, ["flow", "chunk"], "left_semi").unionByName(carried)
        number = len(rounds)
        redone = staged(
            _frame(again, idle_us, gap_us).withColumn("round", F.lit(number)), "framed"
        )
        outdated = (
            edges.join(names, ["flow", "chunk"], "left_semi").select("flow", "chunk", "round")
        )
        replaced = staged(
            outdated if replaced is None else replaced.unionByName(outdated), "replaced"
        )
        rounds.append(redone)
        edges = _latest([r.filter("kind = 'edge'") for r in rounds], replaced)
    inside = marks.filter("status = 'swallowed'").select("flow", "chunk")
    result = _latest([r.filter("kind <> 'edge'") for r in rounds], replaced).join(
        inside, ["flow", "chunk"], "left_anti"
    )
    columns = ("flow", "ts_us", "seq", "n", "kind", "data")
    if seen.spanned:
        joined = staged(_joined(result, marks, keyed, gap_us, seen.swallowed), "joined", ("kind",)).select(*columns)
    else:
        joined = result.sparkSession.createDataFrame([], _WHOLE)
    exits = edges.select("flow", F.col("chunk").alias("before"), F.col("left").alias("state"))
    ended = marks.filter("status IN ('closed', 'left') AND before IS NOT NULL").join(exits, ["flow", "before"])
    messages = result.filter("kind <> 'part' AND origin IS NULL").select(*columns)
    messages = messages.union(joined.filter("kind <> 'left'"))
    closed = ended.filter("status = 'closed'").select("flow", "ts_us", F.col("state").alias("data"))
    left = (
        ended.filter("status = 'left'")
        .select("flow", "ts_us", "state")
        .union(joined.filter("kind = 'left'").select("flow", "ts_us", F.concat(F.lit(FRESH), "data").alias("state")))
    )
    return _named(messages).unionByName(_opened(closed)), left


def _latest(rounds: list[DataFrame], replaced: DataFrame | None) -> DataFrame:
    rows = rounds[0]
    for more in rounds[1:]:
        rows = rows.unionByName(more)
    if replaced is None:
        return rows
    return rows.join(replaced, ["flow", "chunk", "round"], "left_anti")


def _microseconds(text: str) -> int:
    count, unit = text.split()
    factors = {"microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6,
               "hour": 3600 * 10**6}
    return int(count) * factors[unit.rstrip("s")]


def messages_only(framed: DataFrame) -> DataFrame:
    return framed.filter("kind = 'message'").drop("kind").withColumnRenamed("data", "message")


def rejects_only(framed: DataFrame) -> DataFrame:
    return framed.filter("kind = 'reject'").drop("kind")
