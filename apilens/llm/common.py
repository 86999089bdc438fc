"""What several operators share: shared folders, Arrow columns, deterministic range shards."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apilens.staging import staging_root

#: White space of the contracts; ``bytes.split()`` without arguments splits at the same characters.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder of the session."""
    return f"{staging_root(spark)}/apilens-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps reread it after a loss."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of every text, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(
    batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4_000_000
) -> Iterator[pa.RecordBatch]:
    """Cut batches at rows so that the texts of each stay near ``most_bytes``.

    A single longer text is a slice of its own.
    """
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        if not len(lengths):
            continue
        block = np.cumsum(lengths, dtype=np.int64) // most_bytes
        starts = np.concatenate(([0], np.nonzero(np.diff(block))[0] + 1, [len(lengths)]))
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            yield batch.slice(a, b - a)


def fold_of(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))


def fold_number(value: object, modulus: int) -> int:
    """The same remainder for one value in Python."""
    return zlib.crc32(str("" if value is None else value).encode()) % modulus


#: Keys that :func:`shard_bounds` looks at per shard, and at most, however many shards there are.
_KEYS_A_SHARD, _MOST_KEYS = 128, 1 << 16


def shard_bounds(df: DataFrame, key: str, shards: int) -> list[int]:
    """Ascending upper bounds (exclusive) that cut an integer key into about even ranges.

    The bounds come from the keys with the smallest hashes, 128 a shard and 65,536 (half a megabyte) at most, so they
    depend on the keys alone: reruns, other partitionings and retried tasks give the same shards, and what reaches
    the driver does not grow with the table. They only balance the work; every row belongs to one shard. There are
    never more shards than keys looked at. Null keys come first.
    """
    if shards < 2:
        return []
    keys = (
        df.select(F.col(key).cast("long").alias("k"))
        .filter("k IS NOT NULL")
        .select("k", F.xxhash64("k").alias("h"))
        .orderBy("h", "k")
        .limit(min(_KEYS_A_SHARD * shards, _MOST_KEYS))
        .select("k")
    )
    found = np.unique(np.array([r[0] for r in keys.collect()], dtype=np.int64))
    if not len(found):
        return []
    shards = min(shards, len(found))
    cuts = found[(np.arange(1, shards) * len(found)) // shards]
    return np.unique(cuts).tolist()


def with_shard(df: DataFrame, key: str, bounds: list[int], name: str = "shard") -> DataFrame:
    """Number of the range of every row, found by binary search over Arrow batches."""
    if not bounds:
        return df.withColumn(name, F.lit(0))
    array = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(array, keys.to_numpy(), side="right").astype(np.int32))

    first = np.iinfo(np.int64).min
    return df.withColumn(name, shard(F.coalesce(F.col(key).cast("long"), F.lit(int(first)))))
