"""Quality rules on repetition, from suffix arrays over the words of each text.

The words of a batch of texts form one sequence of integers in which no two texts share a number, so one
suffix array serves all of them: groups of suffixes with an equal prefix are split by prefix
doubling, and only groups that are still larger than one suffix are sorted again. The rank tables of the
doublings give the longest common prefix of neighbours in the array. A suffix shares its longest
repeated prefix with a neighbour, so the larger of both neighbouring values is the longest repeat that
begins at its word: the maximal repeated substrings of the longest-common-prefix intervals. The union of
their spans and the longest of them are limited.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apilens.llm.common import slices, text_bytes


@dataclass(frozen=True)
class Limits:
    """What a text may have; a text at a limit passes."""

    least_words: int = 50
    #: Per cent of the words that lie in three-word windows found twice or more.
    repeat_words_percent: int = 50
    #: Words of a repeat that counts for the covered fraction.
    counted_repeat: int = 8
    #: Per cent of the words that such repeats cover.
    covered_percent: int = 30
    #: Words of the longest repeat.
    longest_repeat: int = 60


#: Text for one suffix array; the arrays take about a hundred bytes for each byte of it.
SLICE_BYTES = 1_000_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def longest_repeats(ids: np.ndarray) -> np.ndarray:
    """For every position the length of the longest run from there that also begins elsewhere.

    The caller ends each text by a number that occurs nowhere else.
    """
    n = len(ids)
    longest = np.zeros(n, dtype=np.int64)
    if n < 2:
        return longest
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    first = np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, step = [rank], 1
    while True:
        by_slot = rank[order]
        equal = by_slot[1:] == by_slot[:-1]
        slots = np.nonzero(np.concatenate(([False], equal)) | np.concatenate((equal, [False])))[0]
        if not len(slots):
            break
        suffixes = order[slots]
        pair = rank[suffixes] * n + rank[np.minimum(suffixes + step, n - 1)]
        inner = np.argsort(pair, kind="stable")
        suffixes, pair = suffixes[inner], pair[inner]
        order[slots] = suffixes
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank = rank.copy()
        rank[suffixes] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        levels.append(rank)
        step *= 2
    shared = np.nonzero(levels[0][order[1:]] == levels[0][order[:-1]])[0]
    left, right = order[shared], order[shared + 1]
    common = np.zeros(len(shared), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = np.minimum(left + common, n - 1), np.minimum(right + common, n - 1)
        common += (levels[k][a] == levels[k][b]) * (1 << k)
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def _covered(longest: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
    """Words in the union of repeats of ``least`` words or more (of their first ``width`` words)."""
    at = np.arange(len(longest))
    reach = np.where(longest >= least, at + (longest if width is None else width), 0)
    return np.maximum.accumulate(reach) > at if len(at) else np.zeros(0, bool)


def measure(texts: list[bytes], counted_repeat: int) -> dict[str, np.ndarray]:
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    flat = [x for w in words for x in [*w, b""]]  # an empty word ends each text
    text_of = np.repeat(np.arange(len(texts)), counts + 1)
    numbers, known = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), [])
    longest = longest_repeats(text_of * (len(known) + 1) + numbers)
    ends = np.cumsum(counts + 1) - 1
    longest[ends] = 0

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.bincount(text_of[flags], minlength=len(texts)).astype(np.int64)

    return {
        "n_words": counts,
        "word_chars": np.array([len(b"".join(w).decode("utf-8", "replace")) for w in words], dtype=np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, b"#*$%&|<>")) for t in texts], dtype=np.int64),
        "n_dup_lines": np.array([_duplicate_lines(t) for t in texts], dtype=np.int64),
        "n_repeat_words": per_text(_covered(longest, 3, 3)),
        "covered_words": per_text(_covered(longest, counted_repeat)),
        "longest_repeat": np.maximum.reduceat(longest, ends - counts) if len(texts) else np.zeros(0, np.int64),
    }


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def verdicts(texts: list[bytes], limits: Limits) -> dict[str, np.ndarray]:
    found = measure(texts, limits.counted_repeat)
    n = found["n_words"]
    found["base_failed"] = (n < limits.least_words) | (
        100 * found["n_repeat_words"] > limits.repeat_words_percent * n
    )
    found["kept"] = ~(
        found["base_failed"]
        | (100 * found["covered_words"] > limits.covered_percent * n)
        | (found["longest_repeat"] > limits.longest_repeat)
    )
    return found


def quality(
    docs: DataFrame, limits: Limits = Limits(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, measures, base_failed, kept) of every row.

    A null or empty text has no words and fails. Repeated rows and rows without an id get their own rows; other
    columns are left out, whatever their names.
    """
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = T.StructType(
        [narrow.schema["doc_id"]]
        + [T.StructField(name, T.LongType()) for name in MEASURES]
        + [T.StructField(name, T.BooleanType()) for name in ("base_failed", "kept")]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            found = verdicts(text_bytes(batch.column("text")), limits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(found[name]) for name in schema.names[1:])], names=schema.names
            )

    return narrow.mapInArrow(judge, schema)


def keep_good(docs: DataFrame, limits: Limits = Limits(), text_column: str = "text") -> DataFrame:
    """The rows that pass, with all their columns, in one pass without a shuffle."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column, SLICE_BYTES):
            kept = verdicts(text_bytes(batch.column(text_column)), limits)["kept"]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(judge, docs.schema)
