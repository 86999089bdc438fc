"""Token ids in files of fixed-width bit packing.

A file holds the ids of consecutive documents. Layout, all numbers little-endian:

    header   16 bytes: magic ``TOKBITS1``, bits per id (u4), ids per block (u4)
    blocks   every block holds the same number of ids (the last one is padded with zeros), each id in
             the least number of bits that the vocabulary needs, lowest bit first
    offsets  u8 per block and one for the end: where each block begins in the file
    footer   24 bytes: number of ids (u8), number of blocks (u8), where the offsets begin (u8)

64 ids fill exactly as many 64-bit words as an id has bits, so packing and unpacking are 64 shifts
of whole columns. Any range of ids is read from its blocks alone.

Tasks write under names of their own; the index (Parquet, committed by Spark) names the files of the
attempts that counted, so repeated or lost attempts leave no trace in the result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apilens.llm import tokens
from apilens.llm.common import shard_bounds, slices, text_bytes, with_shard
from apilens.llm.files import filesystem, make_folder

MAGIC = b"TOKBITS1"
BLOCK_IDS = 4096
DOCUMENTS_PER_SHARD = 16_384


def bits_for(vocabulary_size: int) -> int:
    """Least bits that hold every id below ``vocabulary_size``."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids (a multiple of 64 of them) in ``bits`` bits each."""
    rows = ids.astype(np.uint64).reshape(-1, 64)
    words = np.zeros((len(rows), bits), dtype="<u8")
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        words[:, word] |= rows[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= rows[:, i] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack_bits(packed: bytes, bits: int) -> np.ndarray:
    words = np.frombuffer(packed, "<u8").reshape(-1, bits)
    ids = np.empty((len(words), 64), dtype="<u4")
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value |= words[:, word + 1] << np.uint64(64 - shift)
        ids[:, i] = value & mask
    return ids.reshape(-1)


class TokenFileWriter:
    def __init__(self, uri: str, bits: int, block_ids: int = BLOCK_IDS) -> None:
        if block_ids % 64:
            raise ValueError("a block holds a multiple of 64 ids")
        store, path = filesystem(uri)
        self._out = store.open_output_stream(path)
        self._bits, self._block_ids = bits, block_ids
        self._out.write(MAGIC + struct.pack("<II", bits, block_ids))
        self._offsets = [16]
        self._waiting: list[np.ndarray] = []
        self._waiting_ids = 0
        self.n_ids = 0

    def add(self, ids: np.ndarray) -> None:
        self._waiting.append(ids)
        self._waiting_ids += len(ids)
        self.n_ids += len(ids)
        if self._waiting_ids >= 64 * self._block_ids:
            self._flush(self._waiting_ids // self._block_ids * self._block_ids)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self._waiting)
        self._out.write(pack_bits(ids[:n], self._bits))
        size = self._block_ids * self._bits // 8
        self._offsets += [self._offsets[-1] + size * (k + 1) for k in range(n // self._block_ids)]
        self._waiting, self._waiting_ids = [ids[n:]], len(ids) - n

    def close(self) -> None:
        if self._waiting_ids:
            short = -self._waiting_ids % self._block_ids
            self._waiting.append(np.zeros(short, dtype=np.uint32))
            self._waiting_ids += short
            self._flush(self._waiting_ids)
        self._out.write(np.array(self._offsets, "<u8").tobytes())
        self._out.write(struct.pack("<QQQ", self.n_ids, len(self._offsets) - 1, self._offsets[-1]))
        self._out.close()


class TokenFileReader:
    """Random access to a file; the last blocks read are kept for the next range."""

    def __init__(self, uri: str) -> None:
        store, path = filesystem(uri)
        self._in = store.open_input_file(path)
        size = self._in.size()
        head = self._in.read_at(16, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self._bits, self._block_ids = struct.unpack("<II", head[8:])
        self.n_ids, blocks, at = struct.unpack("<QQQ", self._in.read_at(24, size - 24))
        self._offsets = np.frombuffer(self._in.read_at(8 * (blocks + 1), at), "<u8")
        self._first = self._last = 0
        self._ids = np.empty(0, "<u4")

    def read(self, start: int, n: int) -> np.ndarray:
        if start < 0 or start + n > self.n_ids:
            raise IndexError("ids outside the file")
        first, last = start // self._block_ids, -(-(start + n) // self._block_ids)
        if n and not (self._first <= first and last <= self._last):
            # read on a little: ranges are usually asked for in order
            last = min(max(last, first + 64), len(self._offsets) - 1)
            a, b = int(self._offsets[first]), int(self._offsets[last])
            self._ids = unpack_bits(self._in.read_at(b - a, a), self._bits)
            self._first, self._last = first, last
        at = start - self._first * self._block_ids
        return self._ids[at : at + n]

    def close(self) -> None:
        self._in.close()


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    vocabulary_size: int,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    documents_per_shard: int = DOCUMENTS_PER_SHARD,
) -> None:
    """Tokenise whole texts (null: empty), end each by ``end_id``, write ids by ascending id column.

    The id column holds integers. Rows without one come first; repeated ids follow each other in an order
    given by their texts. An empty table writes an empty index.
    """
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    shards = max(1, -(-narrow.count() // documents_per_shard))
    bounds = shard_bounds(narrow, "doc_id", shards)
    bits = bits_for(vocabulary_size)
    data = f"{path}/data"
    make_folder(data)
    schema = T.StructType(
        [
            T.StructField("file", T.StringType()),
            T.StructField("shard", T.IntegerType()),
            T.StructField("doc_id", T.LongType()),
            T.StructField("start_in_file", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode
        end = np.array([end_id], "<u4").tobytes()
        out, name = None, f"{uuid.uuid4().hex}.tokens"
        for batch in slices(batches, "text"):
            out = out or TokenFileWriter(f"{data}/{name}", bits)
            starts, sizes = [], []
            for text in text_bytes(batch.column("text")):
                ids = np.frombuffer(encode(text) + end, "<u4")
                starts.append(out.n_ids)
                sizes.append(len(ids))
                out.add(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(starts), pa.string()),
                    batch.column("shard"),
                    batch.column("doc_id"),
                    pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()),
                ],
                names=schema.names,
            )
        if out:
            out.close()

    (
        with_shard(narrow, "doc_id", bounds)
        .repartitionById(len(bounds) + 1, F.col("shard"))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, schema)
        .write.parquet(f"{path}/index")
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before, ``ids`` are packed
    unsigned little-endian 32-bit integers."""
    index = spark.read.parquet(f"{path}/index")
    # one row per file
    totals = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("ids_in_file"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("ids_in_file").over(before), F.lit(0)).alias("base"))
    data, kept = f"{path}/data", ("doc_id", "start", "n_tokens")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, TokenFileReader] | None = None
        for batch in batches:
            files = batch.column("file").to_pylist()
            starts = batch.column("start_in_file").to_pylist()
            sizes = batch.column("n_tokens").to_pylist()
            ids, held, first = [], 0, 0

            def part(a: int, b: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in kept), pa.array(ids, pa.binary())],
                    names=[*kept, "ids"],
                )

            for i, (name, start, n) in enumerate(zip(files, starts, sizes)):
                if opened is None or opened[0] != name:
                    if opened:
                        opened[1].close()
                    opened = (name, TokenFileReader(f"{data}/{name}"))
                ids.append(opened[1].read(start, n).tobytes())
                held += n
                if held > 1_000_000:
                    yield part(first, i + 1)
                    ids, held, first = [], 0, i + 1
            yield part(first, len(files))
        if opened:
            opened[1].close()

    located = (
        index.join(bases, "file")
        .withColumn("start", F.col("base") + F.col("start_in_file"))
        .select("file", "doc_id", "start_in_file", "start", "n_tokens")
        .repartition(max(1, totals.count()), "file")
        .sortWithinPartitions("file", "start_in_file")
    )
    return located.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
