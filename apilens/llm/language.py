"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built. A text is parsed against it greedily: each
phrase is the longest match that occurs in the language's text. The fewer phrases, the closer the
language; a phrase costs log2 of the training length, so languages with less text are not favoured, and
the language with the fewest bits per character wins.

The automata come from a bounded sample (``SAMPLE_CHARS`` characters a language). Texts are parsed whole: all
texts of a batch are cut into blocks of ``BLOCK`` characters and parsed side by side, a table lookup per
character and language; the end of a block ends a phrase in every language alike.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apilens.llm.common import slices, text_bytes

#: Characters of the sample per language. Of longer texts the start of one is learned, if the language has no others.
SAMPLE_CHARS = 30_000
#: Rows ranked per language when the sample is chosen.
SAMPLE_ROWS = 512
BLOCK = 256
UNKNOWN = "und"
_SPACE, _OTHER = 1, 2  # class 0 pads blocks
_POINTS = 0x110000


def letters_table() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(_POINTS)])


def normalised(text: str) -> str:
    """Lower-case letters (composed), every run of other characters as one space."""
    return unicodedata.normalize("NFC", text).lower()


class SuffixAutomaton:
    """Transitions of the suffix automaton of a sequence of classes; state 0 is the root."""

    def __init__(self, classes: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in classes:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new


class Steps:
    """Step per (state, class): four times the next state, plus the number of phrases that ended.

    A class that the text lacks is a phrase of its own. Padding changes nothing. Few classes make a dense table over the
    classes of the text alone; for many, the edges are sorted by state and class.
    """

    def __init__(self, automaton: SuffixAutomaton, n_classes: int, most_cells: int = 1 << 22) -> None:
        self.n_classes = n_classes
        own = sorted(automaton.next[0])
        # 0 pads, 1 is any class that the text lacks
        self.local = np.ones(n_classes, dtype=np.int32)
        self.local[0] = 0
        self.local[own] = np.arange(2, len(own) + 2)
        self.width, self.states = len(own) + 2, len(automaton.next)
        edges = [(s, c, t) for s, e in enumerate(automaton.next) for c, t in e.items()]
        found = np.array(edges, dtype=np.int64).reshape(-1, 3)
        keys = found[:, 0] * self.width + self.local[found[:, 1]]
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], (4 * found[order, 2]).astype(np.int32)
        # from the root: nothing is open there
        self.root = np.zeros(self.width, dtype=np.int32)
        self.root[self.local[own]] = [4 * automaton.next[0][c] for c in own]
        self.miss = self.root + 1
        self.miss[1] = 2
        self.root[1] = 1
        self.dense: np.ndarray | None = None
        if self.states * self.width <= most_cells:
            table = np.tile(self.miss, (self.states, 1))
            table[0] = self.root
            table[:, 0] = 4 * np.arange(self.states)
            table.reshape(-1)[self.keys] = self.targets
            self.dense = table.reshape(-1)

    def step(self, state: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Steps from states by classes of ``local``."""
        keys = state.astype(np.int64) * self.width + classes
        if self.dense is not None:
            return self.dense[keys]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        missed = np.where(state == 0, self.root[classes], self.miss[classes])
        missed = np.where(classes == 0, 4 * state, missed)
        return np.where(self.keys[at] == keys, self.targets[at], missed).astype(np.int32)

    def __getitem__(self, index: int) -> int:
        state, c = divmod(int(index), self.n_classes)
        return int(self.step(np.array([state]), self.local[[c]])[0])


@dataclass
class LanguageModel:
    languages: list[str]
    steps: list[Steps]
    bits: list[float]
    classes: np.ndarray
    n_classes: int

    @staticmethod
    def fit(texts: dict[str, list[str]]) -> LanguageModel:
        letter = letters_table()
        own = {k: " ".join(map(normalised, v)) for k, v in sorted(texts.items())}
        known = sorted({c for t in own.values() for c in t if letter[ord(c)]})
        classes = np.where(letter, _OTHER, _SPACE).astype(np.int32)
        for i, c in enumerate(known):
            classes[ord(c)] = i + 3
        model = LanguageModel([], [], [], classes, len(known) + 3)
        for language, text in own.items():
            sequence = model._sequence(text)
            if (sequence > _SPACE).any():
                model.languages.append(language)
                model.steps.append(Steps(SuffixAutomaton(sequence.tolist()), model.n_classes))
                model.bits.append(math.log2(len(sequence) + 1))
        return model

    def _sequence(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
        classes = self.classes[points]
        space = classes == _SPACE
        return classes[~space | np.concatenate(([True], ~space[:-1]))] if len(classes) else classes

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score (0 to 1) of every text; a text without letters is unknown, with score 0.

        The score is the share of the winner if every language weighs 2 to the power of -8 times its
        bits per character. Ties go to the smaller name.
        """
        sequences = [self._sequence(normalised(t)) for t in texts]
        lettered = np.array([bool((s > _SPACE).any()) for s in sequences], dtype=bool)
        if not self.languages or not lettered.any():
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        first = np.cumsum(blocks) - blocks
        columns = np.zeros((int(blocks.sum()), BLOCK), dtype=np.int32)
        flat = columns.reshape(-1)
        for s, at in zip(sequences, (first * BLOCK).tolist()):
            flat[at : at + len(s)] = s
        columns = np.ascontiguousarray(columns.T)
        cost = np.empty((len(self.languages), len(texts)))
        for k, steps in enumerate(self.steps):
            state = np.zeros(columns.shape[1], dtype=np.int32)
            phrases = np.zeros(columns.shape[1], dtype=np.int32)
            for column in steps.local[columns]:
                step = steps.step(state, column)
                phrases += step & 3
                state = step >> 2
            phrases += state > 0
            total = np.bincount(owner, weights=phrases, minlength=len(texts))
            cost[k] = total * self.bits[k] / np.maximum(lengths, 1)
        best = cost.argmin(axis=0)
        share = 1 / np.exp2(-8 * (cost - cost.min(axis=0))).sum(axis=0)
        return (
            [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered)],
            [s if ok else 0.0 for s, ok in zip(share.tolist(), lettered)],
        )


def fit(
    labelled: DataFrame,
    sample_chars: int = SAMPLE_CHARS,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
) -> LanguageModel:
    """Learn from the rows with text and label, per language the ones whose ids have the smallest hashes, until
    ``sample_chars`` characters are reached. Only this sample reaches the driver; ranking drops all but
    ``SAMPLE_ROWS`` rows a language before the shuffle."""
    rows = labelled.select(
        F.col(id_column).alias("doc_id"), F.col(language_column).alias("lang"), F.col(text_column).alias("text")
    ).filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    order = W.partitionBy("lang").orderBy("long", "h", "doc_id")
    chosen = (
        rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.length("text").alias("n"))
        .filter("n >= 1")
        .withColumn("long", F.col("n") > sample_chars)
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= SAMPLE_ROWS)
        .withColumn("before", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
        .filter((F.col("before") < sample_chars) & (~F.col("long") | (F.col("place") == 1)))
        .select("lang", "doc_id", "long")
    )
    # at most SAMPLE_ROWS rows of two columns a language
    texts: dict[str, list[str]] = {}
    cut = rows.withColumn("long", F.length("text") > sample_chars).withColumn("text", F.substring("text", 1, sample_chars))
    found = cut.join(F.broadcast(chosen), ["lang", "doc_id", "long"])
    for language, _, text in sorted(found.select("lang", "doc_id", "text").collect()):
        texts.setdefault(language, []).append(text)
    return LanguageModel.fit(texts)


def identify(
    docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; null texts and texts without a letter give ``und`` and 0.

    Repeated rows and rows without an id get their own rows; other columns are left out, whatever their
    names. Without a learned language everything is ``und``.
    """
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = T.StructType(
        [narrow.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t.decode("utf-8", "replace") for t in text_bytes(batch.column("text"))]
            languages, scores = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                names=schema.names,
            )

    return narrow.mapInArrow(predict, schema)
