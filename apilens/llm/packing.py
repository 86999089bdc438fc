"""Best-fit packing of tokenised documents into sequences of bounded length.

Vector best fit: every open sequence has three residual capacities (tokens, documents, attention
cost as the sum of squared piece lengths). Pieces go by falling length; each takes the sequence in
which, of all that can hold it in every dimension, the weighted norm of the residual capacities
after placing it is least. Under that norm the chosen sequence stays the best one for the next piece
of the same length, so all pieces of one length are placed by one vectorised step.

Pieces are narrow rows (no ids), dealt round-robin into groups of bounded size, which are packed
independently: only the last sequences of a group stay badly filled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from apilens.llm import tokens
from apilens.llm.common import slices, stored, text_bytes

#: Rows of one packing group.
GROUP_PIECES = 32_768
#: Weights of the residual tokens, documents and attention cost in the norm.
WEIGHTS = (1.0, 0.01, 0.01)


def document_pieces(
    docs: DataFrame,
    vocabulary: str,
    max_tokens: int = 2048,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    remembered: int = tokens.REMEMBERED,
    forget: bool = False,
) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids: (id, piece, start, length, ids_crc32).

    Each text (null: empty) is tokenised whole and ended by ``end_id``, so every row has at least
    one piece; repeated rows and rows without an id give pieces of their own. Other columns are left
    out, whatever their names. Workers hold up to twice ``remembered`` words; with ``forget`` only as long as a task
    runs, which leaves the memory to other steps.
    """
    narrow = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    schema = T.StructType(
        [
            T.StructField("doc_id", narrow.schema["doc_id"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary, remembered)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * max_tokens
        for batch in slices(batches, "text"):
            row, piece, length, crc = [], [], [], []
            for i, text in enumerate(text_bytes(batch.column("text"))):
                ids = encoder.encode(text) + end
                for k, a in enumerate(range(0, len(ids), step)):
                    part = ids[a : a + step]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            piece_numbers = np.array(piece, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row, pa.int64())),
                    pa.array(piece_numbers),
                    pa.array(piece_numbers.astype(np.int64) * max_tokens),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=schema.names,
            )
        if forget:
            encoder.forget()

    return narrow.mapInArrow(cut, schema)


def best_fit(
    lengths: np.ndarray,
    max_tokens: int,
    max_documents: int,
    max_attention: int,
    weights: tuple[float, float, float] = WEIGHTS,
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece.

    Pieces that alone exceed a capacity raise an error; ties go to the sequence opened first, equal
    lengths keep their order.
    """
    n = len(lengths)
    if n and (lengths.max() > max_tokens or max_documents < 1 or int(lengths.max()) ** 2 > max_attention):
        raise ValueError("a piece exceeds the capacity of an empty sequence")
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(n, dtype=np.int64)
    free = np.empty((0, 3), dtype=np.int64)  # residual tokens, documents, attention cost
    numbers = np.empty(0, dtype=np.int64)  # of the open sequences
    opened = 0
    scale = np.array(weights) / np.array([max_tokens, max_documents, max_attention], dtype=float) ** 2
    at = 0
    while at < n:
        length = int(lengths[order[at]])
        last = at + int(np.searchsorted(-lengths[order[at:]], -length, side="right"))
        need = np.array([length, 1, length * length], dtype=np.int64)
        left = last - at
        room = np.min(free // np.maximum(need, 1), axis=1) if len(free) else np.empty(0, np.int64)
        fits = np.nonzero(room > 0)[0]
        if len(fits):
            after = free[fits] - need
            norm = (after.astype(float) ** 2) @ scale
            fits = fits[np.argsort(norm, kind="stable")]
            total = np.cumsum(room[fits])
            takes = np.minimum(room[fits], np.maximum(0, left - (total - room[fits])))
            used = takes > 0
            chosen, takes = fits[used], takes[used]
            placed = int(takes.sum())
            bins[order[at : at + placed]] = np.repeat(numbers[chosen], takes)
            free[chosen] -= takes[:, None] * need
            at += placed
            left -= placed
        if left:
            each = int(min(max_tokens // max(length, 1), max_documents, max_attention // max(length * length, 1)))
            more = -(-left // each)
            takes = np.full(more, each, dtype=np.int64)
            takes[-1] = left - each * (more - 1)
            new = np.arange(opened, opened + more)
            bins[order[at:last]] = np.repeat(new, takes)
            opened += more
            empty = np.array([max_tokens, max_documents, max_attention], dtype=np.int64)
            free = np.concatenate([free, empty - takes[:, None] * need])
            numbers = np.concatenate([numbers, new])
            at = last
        if at < n:
            # the next pieces are shorter, but no shorter than the last one
            shortest = int(lengths[order[-1]])
            keep = (free[:, 0] >= shortest) & (free[:, 1] > 0) & (free[:, 2] >= shortest * shortest)
            free, numbers = free[keep], numbers[keep]
    offsets = np.empty(n, dtype=np.int64)
    by_bin = np.lexsort((np.arange(n), bins))
    before = np.cumsum(lengths[by_bin]) - lengths[by_bin]
    first = np.concatenate(([True], np.diff(bins[by_bin]) != 0)) if n else np.empty(0, bool)
    offsets[by_bin] = before - np.repeat(before[first], np.diff(np.append(np.nonzero(first)[0], n)))
    return bins, offsets


def pack(
    pieces: DataFrame,
    max_tokens: int = 2048,
    max_documents: int = 2048,
    max_attention: int | None = None,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length``; every row is placed.

    ``max_attention`` bounds the sum of squared lengths of a sequence, by default at what a single
    piece of ``max_tokens`` costs. An empty table gives an empty table.
    """
    attention = max_tokens * max_tokens if max_attention is None else max_attention
    held = stored(pieces, "pieces")
    groups = max(1, -(-held.count() // group_pieces))
    schema = T.StructType(
        [*held.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if group is None or not group.num_rows:
            return
        lengths = group.column("length").to_numpy()
        bins, offsets = best_fit(lengths, max_tokens, max_documents, attention)
        base = TaskContext.get().partitionId() << 40
        yield from (
            group.append_column("sequence_id", pa.array(bins + base))
            .append_column("offset", pa.array(offsets))
            .combine_chunks()
            .to_batches()
        )

    # round-robin: no key decides, so no hot key can fill a group
    return held.repartition(groups).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, max_tokens: int = 2048, **how: str | int | bool) -> DataFrame:
    return pack(document_pieces(docs, vocabulary, max_tokens, **how), max_tokens)
