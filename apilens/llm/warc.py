"""Deterministic sharded WARC archives of pages, and their reader.

Records are shuffled once into ranges of page ids and sorted there. Each range is a shard whose files are rolled
when they reach a compressed size; headers and digests are made anew from the payload. Ranges, order, headers and
compression depend on the pages alone, so a rerun gives the same files byte by byte.

Tasks write under temporary names of their own and list their files in a manifest that Spark commits, so it names
the files of exactly one attempt of each task. Those get their final names, and the final manifest is written
last: an archive without it does not exist for readers, and leftovers of lost attempts are never read.

Which records repeat a payload is decided on narrow rows of digests. The decisions travel to the writers as marker
rows within the same shuffle, so pages are neither joined nor shuffled a second time.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apilens.llm.common import shard_bounds, slices, stored, with_shard
from apilens.llm.files import filesystem, make_folder

PAGES_PER_SHARD = 8_192
ROLL_BYTES = 32_000_000
REVISIT_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = (
    "shard int, part int, temporary string, name string, n_records long, n_bytes long, sha256 string, "
    "first_id long, last_id long"
)
_RECORDS = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
    "payload binary"
)


def record_id(page_id: int | None, repeat: int = 0) -> str:
    name = f"page:{page_id}" if not repeat else f"page:{page_id}:{repeat}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(
    page_id: int | None,
    url: str | None,
    payload: bytes,
    digest: str,
    refers_to: int | None = None,
    revisit: bool = False,
    repeat: int = 0,
) -> bytes:
    """One WARC record. A revisit keeps the HTTP head with the length of the payload, but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    lines += [f"WARC-Record-ID: {record_id(page_id, repeat)}", f"WARC-Date: {DATE}"]
    if url is not None:
        # a header line holds no control characters
        lines.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
        lines.append(f"Refers-To-Page-Id: {refers_to}")
    lines += [
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: All printable ASCII but the percent sign stays as it is.
_URL_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


class ArchiveWriter:
    """One gzip member per record, rolled by compressed size."""

    def __init__(self, folder: str, shard: int, roll_bytes: int) -> None:
        self._store, self._path = filesystem(folder)
        self._shard, self._roll_bytes, self._attempt = shard, roll_bytes, uuid.uuid4().hex
        self._out = None
        self.files: list[dict] = []

    def add(self, page_id: int | None, data: bytes) -> None:
        if self._out is not None and self.files[-1]["n_bytes"] >= self._roll_bytes:
            self.close()
        if self._out is None:
            name = f"pages-{self._shard:06d}-{len(self.files):05d}.warc.gz"
            temporary = f"{name}.{self._attempt}"
            self._out = self._store.open_output_stream(f"{self._path}/{temporary}", compression=None)
            self._hash = hashlib.sha256()
            self.files.append(
                {"shard": self._shard, "part": len(self.files), "temporary": temporary, "name": name, "n_records": 0,
                 "n_bytes": 0, "first_id": page_id}
            )
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self._out.write(member)
        self._hash.update(member)
        file = self.files[-1]
        file["n_records"] += 1
        file["n_bytes"] += len(member)
        file["last_id"] = page_id

    def close(self) -> None:
        if self._out is not None:
            self._out.close()
            self._out = None
            self.files[-1]["sha256"] = self._hash.hexdigest()


def _revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, response_id) of the payloads whose record is not the one with the smallest id."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    digests = stored(
        pages.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n")).filter(
            F.col("n") >= least_bytes
        ),
        "page-digests",
    )
    several = (
        digests.groupBy("digest").agg(F.min("page_id").alias("response_id"), F.count("*").alias("copies")).filter("copies > 1")
    )
    return stored(
        digests.join(several, "digest")
        .filter("response_id IS NOT NULL AND NOT page_id <=> response_id")
        .select("page_id", "digest", "response_id"),
        "revisits",
    )


def write_archives(
    pages: DataFrame,
    path: str,
    roll_bytes: int = ROLL_BYTES,
    pages_per_shard: int = PAGES_PER_SHARD,
    least_bytes: int = REVISIT_BYTES,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> None:
    """Write a record per row (null html: an empty payload; null url: no target).

    Of equal payloads of ``least_bytes`` or more the row with the smallest id is a response and the others revisit it,
    also rows that repeat its id; payloads that only rows without an id have are all responses. Rows
    without an id come first. No rows give an empty manifest. ``path`` is a URI that all tasks reach.
    """
    narrow = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html")
    )
    marks = _revisits(narrow, least_bytes)
    shards = max(1, -(-narrow.count() // pages_per_shard))
    bounds = shard_bounds(narrow, "page_id", shards)
    rows = narrow.select("page_id", "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("response_id"))
    markers = marks.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "response_id")
    waiting = f"{path}/_temporary"
    make_folder(waiting)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, at = None, None
        earlier: dict[str, int] = {}  # digest: response of the page id at hand
        seen: set[str] = set()
        repeat = 0
        for batch in slices(batches, "html"):
            columns = (batch.column(c).to_pylist() for c in ("shard", "page_id", "url", "html", "digest", "response_id"))
            for shard, page_id, url, html, digest, response_id in zip(*columns):
                writer = writer or ArchiveWriter(waiting, shard, roll_bytes)
                if at != (page_id,):
                    at, earlier, seen, repeat = (page_id,), {}, set(), 0
                if digest is not None:
                    earlier[digest] = response_id
                    continue
                payload = (html or "").encode()
                own = hashlib.sha256(payload).hexdigest()
                refers_to = earlier.get(own)
                if refers_to is None and own in seen and page_id is not None:
                    refers_to = page_id
                if len(payload) >= least_bytes:
                    seen.add(own)
                writer.add(page_id, record(page_id, url, payload, own, refers_to, refers_to is not None, repeat))
                repeat += 1
        if writer:
            writer.close()
            fields = [f.split()[0] for f in _MANIFEST.split(", ")]
            types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
            kinds = [types[f.split()[1]] for f in _MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f.get(c) for f in writer.files], k) for c, k in zip(fields, kinds)], names=fields
            )

    pending = (
        with_shard(rows.unionByName(markers), "page_id", bounds)
        .repartitionById(len(bounds) + 1, F.col("shard"))
        # markers before the pages that they belong to
        .sortWithinPartitions(F.col("page_id"), F.col("response_id").isNull(), "url", "html")
        .mapInArrow(write, _MANIFEST)
    )
    pending.write.parquet(f"{path}/_pending")
    _commit(pages.sparkSession, path)


def _commit(spark: SparkSession, path: str) -> None:
    """Give the files of the pending manifest their final names, then write the manifest. May be repeated."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(path)
        for batch in batches:
            for row in batch.to_pylist():
                final = f"{folder}/{row['name']}"
                there = store.get_file_info(f"{folder}/_temporary/{row['temporary']}")
                if there.type != fs.FileType.NotFound:
                    store.move(there.path, final)
                if store.get_file_info(final).size != row["n_bytes"]:
                    raise OSError(f"{final} is incomplete")
            yield batch

    spark.read.schema(_MANIFEST).parquet(f"{path}/_pending").mapInArrow(rename, _MANIFEST).write.parquet(f"{path}/manifest")


def _members(store: fs.FileSystem, path: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Records of one archive; no more than one of them and one chunk are in memory."""
    with store.open_input_stream(path, compression=None) as source:
        data, unpacker, parts = source.read(chunk), zlib.decompressobj(31), []
        while data:
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = zlib.decompressobj(31), []
            data = data or source.read(chunk)
        if parts:
            raise OSError(f"{path} ends within a record")


def parse_record(data: bytes) -> dict:
    """Fields of one record; digests and lengths are checked against the bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response":
        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    page, refers = fields.get("Page-Id"), fields.get("Refers-To-Page-Id")
    return {
        "page_id": int(page) if page else None,
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": int(refers) if refers else None,
        "payload": payload if kind == "response" else None,
    }


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the files in the manifest, one row each; without ``payloads`` that column is null."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
         ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(path)
        rows, size = [], 0
        for batch in batches:
            for name in batch.column("name").to_pylist():
                for data in _members(store, f"{folder}/{name}"):
                    row = parse_record(data)
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").select("name")
    # a task per file: rows of names are too small for Spark to tell how much work they are
    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, _RECORDS)
