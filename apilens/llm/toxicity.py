"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, their stems (the first ``STEM`` letters, for endings
never seen), word pairs and pairs with one word between them. The learner keeps a rate per coordinate and drives the weights of uninformative features to zero (L1), so
what is left is a small table of weights that every task holds. Training sees a bounded sample of labelled
rows (``SAMPLE_ROWS``) in one task, in the order of their hashes; scoring sees every text whole.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apilens.llm.common import slices, stored, text_bytes

BITS = 22
STEM = 4
#: Labelled rows that are learned from, and the characters of the longest of them.
SAMPLE_ROWS = 8_000
SAMPLE_CHARS = 50_000
_REMEMBERED = 400_000
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX, _STEM_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


@dataclass(frozen=True)
class Rates:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.0
    epochs: int = 5


class WordHashes:
    """Hashes of lower-cased words without the marks around them, those of their stems in the upper half.

    Words seen lately are looked up.
    """

    def __init__(self) -> None:
        self._known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> list[int]:
        get = self._known.get
        found = [get(w) for w in words]
        if None in found:
            if len(self._known) > _REMEMBERED:
                self._known = {}
            for i, value in enumerate(found):
                if value is None:
                    value = self._hash(words[i])
                    if len(words[i]) <= 64:
                        self._known[words[i]] = value
                    found[i] = value
        return found

    @staticmethod
    def _hash(word: bytes) -> int:
        plain = word.lower().strip(_EDGES)
        stem = plain.decode("utf-8", "replace")[:STEM].encode()
        return zlib.crc32(stem) << 32 | zlib.crc32(plain)


def features(texts: list[bytes], hashes: WordHashes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word, stem, pair and skip-gram, repeats included; feature 0 is the bias."""
    found = [hashes.of(t.split()) for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    owner = np.repeat(np.arange(len(texts)), counts)
    words = np.fromiter(itertools.chain.from_iterable(found), np.uint64, int(counts.sum()))
    spread = ((words & np.uint64(0xFFFFFFFF)) + np.uint64(1)) * _MIX
    stems = ((words >> np.uint64(32)) + np.uint64(1)) * _STEM_MIX
    owners, values = [np.arange(len(texts)), owner, owner], [spread, stems]
    for gap, factor in ((1, _PAIR), (2, _SKIP)):
        same = owner[gap:] == owner[:-gap]
        owners.append(owner[gap:][same])
        values.append(((spread[:-gap] ^ (spread[:-gap] >> np.uint64(29))) * factor + spread[gap:])[same])
    shift = np.uint64(64 - bits)
    hashed = [np.zeros(len(texts), np.int64)]
    for v in values:
        v = (v ^ (v >> np.uint64(31))) * _PAIR
        hashed.append(np.maximum((v >> shift).astype(np.int64), 1))
    return np.concatenate(owners), np.concatenate(hashed)


def train(texts: list[bytes], labels: list[int], rates: Rates = Rates(), bits: int = BITS) -> dict[int, float]:
    """Weights that are not zero. One example at a time, in the given order, ``epochs`` times."""
    hashes = WordHashes()
    examples = []
    for a in range(0, len(texts), 200):
        owner, feature = features(texts[a : a + 200], hashes, bits)
        keys = np.unique(owner << bits | feature)
        edges = np.searchsorted(keys, np.arange(len(texts[a : a + 200]) + 1) << bits)
        mask = (1 << bits) - 1
        examples += [(keys[i:j] & mask).astype(np.int32) for i, j in zip(edges[:-1], edges[1:])]
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * rates.l1) / ((rates.beta + np.sqrt(n[at])) / rates.alpha + rates.l2)
        return np.where(np.abs(zs) <= rates.l1, 0.0, w)

    for _ in range(rates.epochs):
        for at, label in zip(examples, labels):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            before = n[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / rates.alpha * w
            n[at] = after
    touched = np.nonzero(np.abs(z) > rates.l1)[0]
    return dict(zip(touched.tolist(), weights(touched).tolist()))


class Scorer:
    def __init__(self, weights: dict[int, float], bits: int = BITS) -> None:
        self._bits = bits
        self._bias = weights.get(0, 0.0)
        self._weights = np.zeros(1 << bits, dtype=np.float32)
        for feature, weight in weights.items():
            self._weights[feature] = weight if feature else 0.0
        self._hashes = WordHashes()

    def score(self, texts: list[bytes]) -> np.ndarray:
        owner, feature = features(texts, self._hashes, self._bits)
        hit = np.nonzero(self._weights[feature])[0]
        keys = np.unique(owner[hit] << self._bits | feature[hit])
        total = np.bincount(
            keys >> self._bits, weights=self._weights[keys & ((1 << self._bits) - 1)], minlength=len(texts)
        )
        return 1 / (1 + np.exp(-np.clip(total + self._bias, -35, 35)))


def fit(
    labelled: DataFrame,
    docs: DataFrame,
    rates: Rates = Rates(),
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> DataFrame:
    """(feature, weight) learned from ``labelled`` (id, label), one row per weight that is not zero.

    Labels without value or document are left out, of several labels of an id the highest counts. The sample are the
    ``SAMPLE_ROWS`` ids with the smallest hashes.
    """
    sample = (
        labelled.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("label"))
        .filter("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE_ROWS)
    )
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).filter(
        F.length("text") <= SAMPLE_CHARS
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            row
            for b in batches
            for row in zip(b.column("h").to_pylist(), b.column("label").to_pylist(), text_bytes(b.column("text")))
        ]
        rows.sort()
        found = train([r[2] for r in rows], [r[1] for r in rows], rates)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.float64())], names=["feature", "weight"]
        )

    # the sample has at most SAMPLE_ROWS rows of two numbers
    return stored(
        texts.join(F.broadcast(sample), "doc_id")
        .select(F.xxhash64("doc_id").alias("h"), "label", "text")
        .repartition(1)
        .mapInArrow(learn, "feature long, weight double"),
        "toxicity-weights",
    )


def score(docs: DataFrame, weights: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) of every row; null texts count as empty and get the score of the bias.

    Repeated rows and rows without an id get their own rows; other columns are left out, whatever their
    names. The weights are at most one per feature number; they are what the driver hands to the tasks.
    """
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("score", T.DoubleType())])
    table = {r["feature"]: r["weight"] for r in weights.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, "text"):
            found = scorer.score(text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=schema.names)

    return narrow.mapInArrow(compute, schema)
