"""Collocations of two to four words with weighted acyclic automata.

Each task counts the n-grams of its texts into a count transducer that grows block by block, and hands its parts to
ranges of two-word beginnings; there the transducers of all tasks are united, weights added, and n-grams below
the threshold leave. The transducers of what is left are then composed with the parts of all candidates, which gives the
counts that scores need.

Three passes count words, pairs, and runs of three and four. A frequent run consists of frequent pairs, and those of
frequent words, so a pass counts only what the pass before left open. What is frequent is sent to the tasks as a bitmap of
hashes of fixed size: a hash that is set by mistake costs a count that is thrown away later, and changes no result.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from apilens.llm.automata import Transducer, union
from apilens.llm.common import slices, stored, text_bytes

LEAST_COUNT = 30
LONGEST = 4
PER_LANGUAGE = 2000
#: A candidate leaves for a longer one with this percentage of its count.
COVERED_PERCENT = 80
SCALE = 2_000_000
UNKNOWN_LANGUAGE = "und"

#: Bits of the bitmap of frequent hashes (8 MB); in a larger corpus it only holds back fewer n-grams.
_BITS = 26
#: A task unites the largest of its transducers when all of them have so many arcs, and hands it on if half remain.
_MOST_ARCS = 2_000_000
_BLOCK = 4_000_000
#: Bytes of transducers after which a batch of them leaves a task.
_HANDED_BYTES = 2_000_000
#: Of texts, a task holds so many on the heap and so many bytes beside it and in Python.
_HELD_AT_ONCE = {
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}
#: Text bytes per prefix range, and the numbers of ranges between which that chooses.
_RANGE_BYTES, _FEWEST_RANGES, _MOST_RANGES = 100_000_000, 64, 1 << 15
#: Salts of the first of the two rankings.
_SALTS = 32

# Characters that end a piece become line feeds, tabs become spaces.
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if c in _PIECE_ENDS else 32 if c == 9 else c for c in range(256))
_BLANK = re.compile(rb"[ \n]")

Bits = np.ndarray | None


def _cut(text: bytes) -> Iterator[bytes]:
    """Blocks of a text that end behind a blank."""
    at = 0
    while at < len(text):
        cut = _BLANK.search(text, min(at + _BLOCK, len(text)))
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair from the hashes of its words."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64((1 << _BITS) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _count_block(block: bytes, carry: list[bytes], lang: str, lengths: tuple[int, ...], bits: Bits) -> tuple[Transducer, list[bytes]]:
    """Counts of the n-grams that end in a block (lower case, blanks and piece ends unified) and its last words."""
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    end, nothing = numbers[b"\n"], numbers[b""]
    tokens = carry + block.replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
    real = ids != nothing
    first_new = int(real[: len(carry)].sum())
    ids = ids[real]
    words = list(numbers)
    good = np.ones(len(words), dtype=bool)
    hashes = None
    if bits is not None:
        hashes = _word_hashes(words, lang)
        if min(lengths) == 2:
            good = _is_set(bits, hashes)
    good[[end, nothing]] = False
    usable = good[ids]
    runs = []
    pairs = usable[:-1] & usable[1:]
    if min(lengths) > 2:
        at = np.nonzero(pairs)[0]
        pairs[at] = _is_set(bits, _mixed(hashes[ids[at]], hashes[ids[at + 1]]))
    for n in lengths:
        starts = usable if n == 1 else pairs[: len(ids) - n + 1].copy()
        for i in range(1, n - 1):
            starts &= pairs[i : i + len(starts)]
        at = np.nonzero(starts)[0]
        at = at[at + n > first_new]
        grams = np.column_stack([ids[at + i] for i in range(n)]) if len(at) else np.empty((0, n), np.int64)
        runs.append((grams, np.ones(len(grams), dtype=np.int64)))
    # only words that are used stay in the alphabet
    used = np.zeros(len(words), dtype=bool)
    for grams, _ in runs:
        used[grams.ravel()] = True
    number = np.cumsum(used) - 1
    alphabet = [words[i] for i in np.nonzero(used)[0].tolist()]
    last = [words[i] for i in ids[len(ids) - LONGEST + 1 :].tolist()] if len(ids) >= LONGEST else [words[i] for i in ids.tolist()]
    return Transducer.of_ids(alphabet, [(number[g], c) for g, c in runs]), last


def _beginnings(automaton: Transducer, lang: str) -> np.ndarray:
    """Hash of the first two words of every path that has them, of the word where all paths have one."""
    hashes = _word_hashes(automaton.words, lang)
    parent, label, _ = automaton.levels[min(1, len(automaton.levels) - 1)]
    return hashes[label] if len(automaton.levels) == 1 else _mixed(hashes[automaton.levels[0][1]][parent], hashes[label])


def _counter(lengths: tuple[int, ...], ranges: int, bits: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def handed_on(lang: str, parts: list[Transducer]) -> Iterator[pa.RecordBatch]:
        whole = parts[0] if len(parts) == 1 else union(parts)
        parts.clear()
        if not whole.arcs:
            return
        place = (_beginnings(whole, lang) >> np.uint64(40)).astype(np.int64) * ranges >> 24
        used = np.unique(place).tolist()
        at, messages, size = [], [], 0
        for r in used:
            at.append(r)
            messages.append(whole.select(place == r).pack())
            size += len(messages[-1])
            if size >= _HANDED_BYTES or r == used[-1]:
                columns = [pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(messages, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "range", "automaton"])
                at, messages, size = [], [], 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value if bits is not None else None
        held: dict[str, list[Transducer]] = defaultdict(list)
        arcs: dict[str, int] = defaultdict(int)
        for batch in slices(batches, "text", _BLOCK):
            texts = defaultdict(list)
            for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text"))):
                texts[lang].append(text)
            for lang, some in texts.items():
                carry: list[bytes] = []
                for block in _cut(b"\n".join(some).lower().translate(_TABLE)):
                    counted, carry = _count_block(block, carry, lang, lengths, known)
                    held[lang].append(counted)
                    arcs[lang] += counted.arcs
                    if len(held[lang]) >= 16:
                        held[lang] = [union(held[lang])]
                        arcs[lang] = held[lang][0].arcs
                    if sum(arcs.values()) > _MOST_ARCS:
                        most = max(arcs, key=arcs.__getitem__)
                        held[most] = [union(held[most])]
                        arcs[most] = held[most][0].arcs
                        if 2 * sum(arcs.values()) > _MOST_ARCS:
                            yield from handed_on(most, held.pop(most))
                            del arcs[most]
        for lang, parts in held.items():
            yield from handed_on(lang, parts)

    return count


_FREQUENT = "lang string, words int, phrase string, f long, hash long"


def _uniter(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Unite the automata of each (lang, range), which come one after the other; frequent paths leave as rows.

    A row with 0 words carries the sum of all words.
    """

    def rows(lang: str, automaton: Transducer) -> Iterator[pa.RecordBatch]:
        hashes = _word_hashes(automaton.words, lang)
        if len(automaton.levels) == 1:
            yield batch_of(lang, 0, [b""], np.array([automaton.levels[0][2].sum()]), np.zeros(1, np.uint64))
        for n, ids, weights in automaton.paths(least):
            if len(ids):
                words = np.array(automaton.words, dtype=object)[ids]
                phrases = [b" ".join(w) for w in words]
                hash_of = hashes[ids[:, 0]] if n == 1 else _mixed(hashes[ids[:, 0]], hashes[ids[:, 1]])
                yield batch_of(lang, n, phrases, weights, hash_of)

    def batch_of(lang: str, n: int, phrases: list[bytes], weights: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        k = len(phrases)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * k, pa.string()),
                pa.array([n] * k, pa.int32()),
                pa.array(phrases, pa.binary()).cast(pa.string()),
                pa.array(weights, pa.int64()),
                pa.array(hashes.view(np.int64), pa.int64()),
            ],
            names=["lang", "words", "phrase", "f", "hash"],
        )

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, whole, waiting, size = None, Transducer([], []), [], 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("lang", "range", "automaton"))
            for lang, place, message in zip(*columns):
                if (lang, place) != key:
                    if key is not None:
                        yield from rows(key[0], union([whole, *waiting]))
                    key, whole, waiting, size = (lang, place), Transducer([], []), [], 0
                waiting.append(Transducer.unpack(message))
                size += len(message)
                if size > 4_000_000 + 12 * whole.arcs:
                    whole, waiting, size = union([whole, *waiting]), [], 0
        if key is not None:
            yield from rows(key[0], union([whole, *waiting]))

    return unite


def _frequent(texts: DataFrame, lengths: tuple[int, ...], ranges: int, least: int, bits: object) -> DataFrame:
    """(lang, words, phrase, f, hash) of the n-grams of these lengths with ``least`` occurrences or more."""
    shards = texts.mapInArrow(_counter(lengths, ranges, bits), "lang string, range int, automaton binary")
    dealt = shards.repartition(ranges, "range", "lang").sortWithinPartitions("lang", "range")
    return stored(dealt.mapInArrow(_uniter(least), _FREQUENT), f"frequent-{max(lengths)}")


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """Bits of the hashes; put together by Spark, at most ``2 ** (_BITS - 18)`` kilobytes reach the driver."""
    bit = F.col("hash").bitwiseAND(F.lit((1 << _BITS) - 1)) + 1
    bits = np.zeros(1 << (_BITS - 3), dtype=np.uint8)
    rows = (
        frequent.filter("words > 0")
        .groupBy(F.bitmap_bucket_number(bit).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    )
    for bucket, some in rows.collect():
        at = (bucket - 1) * len(some)
        bits[at : at + len(some)] = np.frombuffer(some, np.uint8)
    return bits


def frequent_phrases(
    docs: DataFrame,
    least: int = LEAST_COUNT,
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """(lang, words, phrase, f) of all phrases of one to four words that occur ``least`` times or more, and per language
    rows with 0 words whose f add up to the number of all its words."""
    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit(UNKNOWN_LANGUAGE))
    texts = docs.select(lang.alias("lang"), F.col(text_column).alias("text"))
    size = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(_MOST_RANGES, max(_FEWEST_RANGES, size // _RANGE_BYTES))
    context = docs.sparkSession.sparkContext
    for name, value in _HELD_AT_ONCE.items():
        docs.sparkSession.conf.set(name, value)
    found = [_frequent(texts, (1,), ranges, least, None)]
    for lengths in ((2,), tuple(range(3, LONGEST + 1))):
        bits = context.broadcast(_bitmap(found[-1]))  # of fixed size
        found.append(_frequent(texts, lengths, ranges, least, bits))
    return found[0].union(found[1]).union(found[2]).drop("hash")


def _composed(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(lang, phrase, k, side, f) for ``asked`` (lang, part, phrase, k, side): counts of parts of phrases.

    Both sides meet by language and the first two words of the part; the counts there become a transducer, which is
    composed with the parts.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    beginning = F.substring_index("part", " ", 2)
    sides = counts.select(
        "lang", F.col("phrase").alias("part"), "f", F.lit("").alias("phrase"), F.lit(0).alias("k"), F.lit("").alias("side")
    ).unionByName(asked.withColumn("f", F.lit(0).cast("long")))
    dealt = (
        sides.withColumn("range", F.pmod(F.xxhash64("lang", beginning), F.lit(parts)).cast("int"))
        .repartition(parts, "lang", "range")
        .sortWithinPartitions("lang", "range", "k", "part")
    )
    schema = "lang string, phrase string, k int, side string, f long"

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton = None, Transducer([], [])
        known: list[pa.RecordBatch] = []
        for batch in batches:
            names = zip(batch.column("lang").to_pylist(), batch.column("range").to_pylist(), batch.column("k").to_pylist())
            marks = [(lang, place, k == 0) for lang, place, k in names]
            starts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            for a, b in zip(starts[:-1], starts[1:]):
                lang, place, counted = marks[a]
                piece = batch.slice(a, b - a)
                if (lang, place) != key:
                    key, known, automaton = (lang, place), [], Transducer([], [])
                if counted:
                    known.append(piece)
                    continue
                if known:
                    phrases = [p for b in known for p in text_bytes(b.column("part"))]
                    automaton = Transducer.of_phrases(phrases, [f for b in known for f in b.column("f").to_pylist()])
                    known = []
                found = automaton.weights_of(text_bytes(piece.column("part")))
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in ("lang", "phrase", "k", "side")), pa.array(found)],
                    names=["lang", "phrase", "k", "side", "f"],
                )

    return dealt.select("lang", "range", "part", "phrase", "k", "side", "f").mapInArrow(compose, schema)


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def _scored(counts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Add l, r, score of the lowest-scoring cut to (lang, words, phrase, a)."""
    words = F.split("phrase", " ", -1)
    cuts = candidates.select(
        "lang", "phrase", words.alias("parts"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    )
    first = F.array_join(F.slice("parts", F.lit(1), F.col("k")), " ")
    rest = F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts") - F.col("k")), " ")
    asked = cuts.select(
        "lang", "phrase", "k", F.explode(F.create_map(F.lit("l"), first, F.lit("r"), rest)).alias("side", "part")
    )
    found = _composed(counts, asked).groupBy("lang", "phrase", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r")
    )
    both = found.join(candidates, ["lang", "phrase"])
    score = F.expr("cast(2000000 * cast(a as decimal(25,0)) as decimal(38,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = both.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "words", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    return lowest.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _covered(candidates: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of the candidates within a longer one that is nearly as frequent."""
    longer = candidates.filter("words > 2").select("lang", "a", "words", F.split("phrase", " ", -1).alias("parts"))
    places = longer.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn(
        "i", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1))
    )
    inner = places.select("lang", F.array_join(F.slice("parts", F.col("i"), F.col("n")), " ").alias("phrase"), "a")
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    both = candidates.join(most, ["lang", "phrase"])
    return both.filter(_exact("longest") * 100 >= _exact("a") * percent).select("lang", "phrase")


def collocations(
    docs: DataFrame,
    least: int = LEAST_COUNT,
    per_language: int = PER_LANGUAGE,
    covered_percent: int = COVERED_PERCENT,
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of every language.

    Null texts are empty, a null language is ``und``. Pieces end with a text, however long it is; texts of any length
    are counted whole, block by block. Repeated rows count as often as they stand there. Ties go to the higher count,
    then the smaller phrase. A table without frequent phrases, or an empty one, gives an empty result.
    """
    counts = stored(frequent_phrases(docs, least, text_column, lang_column), "frequent")
    totals = counts.filter("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = counts.filter("words > 0")
    candidates = phrases.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    scored = _scored(phrases, candidates).join(_covered(candidates, covered_percent), ["lang", "phrase"], "left_anti")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = F.row_number().over(W.partitionBy("lang", "salt").orderBy(*best))
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    few = salted.withColumn("place", some).filter(F.col("place") <= per_language)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*best))  # of at most _SALTS * per_language rows
    return (
        few.withColumn("rank", rank.cast("long"))
        .filter(F.col("rank") <= per_language)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
