"""Importance resampling towards a target distribution by hashed word features.

Words come from an untrained ``Split`` pre-tokenizer with a regular expression over ASCII-lowered text, as words with
offsets; windows over the offset pairs are the features, and the CRC-32 of a feature is its bucket. A bucket
gains by how much more frequent it is in the target than in the corpus (log ratio with one added to every bucket), a
document weighs the sum of its features' gains, and the documents with the highest weights plus Gumbel noise of
their ids are drawn, which is sampling without replacement in proportion to the weights.

Texts are split once; their buckets are stored at two bytes a feature, and counted and weighed from there. Every
count covers all rows. A task holds one histogram; the only thing that reaches the driver is one gain per bucket.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from apilens.llm.common import slices, stored, text_bytes

# The characters of words and the distribution's parameters.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LONGEST_FEATURE = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
UNIT = 1000

_BETWEEN_WORDS = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Texts are split in blocks of about this size, which end between words.
_BLOCK = 1 << 20
#: Words whose buckets a worker remembers; when full it starts anew.
_REMEMBERED = 200_000


def _blocks(text: bytes) -> Iterator[str]:
    at = 0
    while at < len(text):
        cut = _BETWEEN_WORDS.search(text, min(at + _BLOCK, len(text)))
        end = cut.end() if cut else len(text)
        yield text[at:end].decode("utf-8", "replace")
        at = end


class FeatureHasher:
    """Buckets of all runs of 1 to ``longest`` words of a text."""

    def __init__(self, longest: int = LONGEST_FEATURE, buckets: int = BUCKETS) -> None:
        if longest < 1 or buckets < 1:
            raise ValueError("features have a word at least, and there is a bucket at least")
        self.longest, self.buckets = longest, buckets
        self._split = pre_tokenizers.Split(Regex(WORD_PATTERN), "removed", invert=True)
        self._known: dict[str, int] = {}

    def _bucket(self, feature: str) -> int:
        found = self._known.get(feature)
        if found is None:
            if len(self._known) >= _REMEMBERED:
                self._known.clear()
            found = self._known[feature] = zlib.crc32(feature.encode()) % self.buckets
        return found

    def features(self, text: bytes) -> tuple[np.ndarray, int]:
        """(bucket of every feature, number of words)."""
        parts: list[np.ndarray] = []
        words = 0
        before: list[str] = []
        bucket, known = self._bucket, self._known.get
        for block in _blocks(text.lower()):
            pieces = self._split.pre_tokenize_str(block)
            words += len(pieces)
            found = [known(w) for w, _ in pieces]
            if None in found:
                found = [bucket(w) if b is None else b for b, (w, _) in zip(found, pieces)]
            parts.append(np.array(found, dtype=np.uint32))
            if self.longest > 1:
                offsets = [o for _, o in pieces]
                parts += self._windows(block, offsets, before)
                before = (before + [block[a:b] for a, b in offsets[-self.longest + 1 :]])[-self.longest + 1 :]
        return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), words

    def _windows(self, block: str, offsets: list[tuple[int, int]], before: list[str]) -> Iterator[np.ndarray]:
        """Features of two words and more that end in this block; ``before`` are the last words of the block before."""
        line = before + [block[a:b] for a, b in offsets]
        for n in range(2, self.longest + 1):
            first = max(0, len(before) - n + 1)
            runs = (" ".join(line[i : i + n]) for i in range(first, len(line) - n + 1))
            yield np.fromiter((zlib.crc32(r.encode()) % self.buckets for r in runs), np.uint32)


def bucketed(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", longest: int = LONGEST_FEATURE, buckets: int = BUCKETS
) -> DataFrame:
    """(doc_id, n_features, n_words, buckets) of every row; ``buckets`` are packed integers of 16 or 32 bits."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_features long, n_words long, buckets binary"
    packed = _packing(buckets)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = FeatureHasher(longest, buckets)
        for batch in slices(batches, "text"):
            found = [hasher.features(t) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(f) for f, _ in found], pa.int64()),
                    pa.array([n for _, n in found], pa.int64()),
                    pa.array([f.astype(packed).tobytes() for f, _ in found], pa.binary()),
                ],
                names=["doc_id", "n_features", "n_words", "buckets"],
            )

    return narrow.mapInArrow(compute, schema)


def _packing(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def histogram(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the whole table fall into each bucket; one array a task, one sum per bucket here."""
    packed = _packing(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for row in batch.column("buckets"):
                counts += np.bincount(np.frombuffer(row.as_buffer() or b"", packed), minlength=buckets)
        used = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["bucket", "n"])

    rows = features.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, dtype=np.int64)
    for bucket, n in rows.collect():  # a row per bucket
        counts[bucket] = n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray, unit: int = UNIT) -> np.ndarray:
    """Per bucket the rounded-down log ratio of the smoothed frequencies in the target and in the corpus."""
    added = len(corpus)
    s_all, t_all = float(corpus.sum() + added), float(target.sum() + added)
    ratios = ((float(t) + 1.0) * s_all / ((float(s) + 1.0) * t_all) for s, t in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(unit * math.log(r)) for r in ratios], dtype=np.int64)


def _weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    packed = _packing(len(gain))
    schema = f"doc_id {features.schema['doc_id'].dataType.simpleString()}, n_features long, n_words long, weight long"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gain[np.frombuffer(b.as_buffer() or b"", packed)].sum()) for b in batch.column("buckets")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_features", "n_words")), pa.array(weights, pa.int64())],
                names=["doc_id", "n_features", "n_words", "weight"],
            )

    return features.mapInArrow(weigh, schema)


def noise(id_column: Column, seed: int = SEED, unit: int = UNIT) -> Column:
    """Gumbel noise of an id in units, rounded down; a missing id counts as empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-unit * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """Add ``rank`` to the rows drawn: highest scores, then smallest ids.

    Rows are dealt to ranges of the order, whose sizes are then known, so only the ranges that reach into the draw
    are sorted and numbered, each by itself.
    """
    spark = scored.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    dealt = (
        scored.filter(F.col("n_words") >= least_words).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    )
    dealt = stored(dealt, "score-ranges")
    sizes = dealt.groupBy("part").count()
    line = W.orderBy("part")
    upto = F.sum("count").over(line.rowsBetween(W.unboundedPreceding, 0))
    plan = stored(
        sizes.select(
            "part",
            (upto - F.col("count")).alias("base"),
            F.floor(F.sum("count").over(W.partitionBy()) * percent / 100).alias("draw"),
        ),
        "score-plan",
    )
    placed = dealt.join(F.broadcast(plan), "part")  # one row per partition
    inside = placed.filter("base < draw").withColumn(
        "rank", F.col("base") + F.row_number().over(W.partitionBy("part").orderBy(*order))
    )
    drawn = inside.withColumn("rank", F.when(F.col("rank") <= F.col("draw"), F.col("rank")).cast("long"))
    rest = placed.filter("base >= draw").unionByName(scored.filter(F.col("n_words") < least_words), allowMissingColumns=True)
    columns = ["doc_id", "n_features", "weight", "score"]
    return drawn.select(*columns, "rank").union(rest.select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST_FEATURE,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_column: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ``rank`` counts the rows drawn from 1.

    Drawn are ``percent`` of the rows with ``least_words`` words or more, rounded down. Null and empty texts have no
    features, weight 0 and are never drawn. Rows without an id share the noise of the empty id and lose ties;
    repeated rows are rows of their own. An empty corpus gives an empty result, an empty target the gains of equal
    counts. Texts of any length are split whole. Other columns are left out, whatever their names.
    """
    features = stored(bucketed(docs, id_column, text_column, longest, buckets), "bucketed")
    corpus = histogram(features, buckets)
    wanted = histogram(bucketed(target.select(F.lit(0).alias("doc_id"), F.col(target_column).alias("text")), longest=longest, buckets=buckets), buckets)
    weighed = _weighed(features, gains(corpus, wanted))
    scored = weighed.withColumns(
        {"score": F.col("weight") + noise(F.col("doc_id"), seed), "row": F.monotonically_increasing_id()}
    )
    return _ranked(stored(scored, "scored"), least_words, percent)


def drawn_documents(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", **how: object) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id was drawn; all rows of an id go with it."""
    drawn = resample(docs, target, id_column=id_column, **how).filter("rank IS NOT NULL")
    ids = stored(drawn.select(F.col("doc_id").alias("_drawn")).distinct(), "drawn")
    return docs.join(ids, F.col(id_column).eqNullSafe(F.col("_drawn")), "left_semi")
