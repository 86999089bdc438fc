"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A 64-bit fingerprint is the bitwise majority of the hashes of a document's word shingles. Two
fingerprints that differ in at most three bits differ in at most one bit (half the radius) of one of
their 32-bit halves. So every distinct fingerprint emits, for both halves, all variants within that
radius (33 each); variants are shuffled to the halves of all fingerprints, and the pairs that meet are
verified on all 64 bits and deduplicated. No pair at distance three or less is lost, copies with equal
fingerprints are one row here, and only verified pairs leave the join.

Three bits of 64 are a strict rule: a text of 250 words with one other word is beyond it about every second time.
``similar_documents`` is therefore an exact join on the Jaccard similarity of the sets of word shingles. Shingles are
put in one order, common ones last; two sets of similarity 0.8 share one of the first fifth of the larger set and the first
ninth of the smaller. Texts that meet in such a shingle are first compared with one of them, which joins large groups
in a number of comparisons that grows with their size. The texts that meet and are not yet in one group are then compared with
drawn ones, few in the first round, eight times as many in each further one, at last all: what a round joins leaves the next
ones, so the similar pairs of a large group are never listed, and at the end the groups are those of a comparison of all pairs.
Shingles in which only a few texts meet need no rounds: their pairs are a small multiple of the texts and come last.
The links are one per text and round at most and never more than the texts. Texts are read again for the keys that pairs ask
for, not stored a second time.

``drop_similar`` unites the groups of both: links between fingerprints and links between sets of shingles.

Every set carries a sketch of 512 bits, the parity of its shingles in each place. Two sketches differ in no more places than
the sets have shingles apart, so pairs that differ in too many are left out without their texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apilens.llm.common import slices, stored, text_bytes
from apilens.llm.components import connected_components

SEED = 42
#: Least Jaccard similarity of ``similar_documents``, in percent.
SIMILARITY = 80
#: Common shingles are found in one of ``_SAMPLE`` texts, as those of at least ``_COMMON`` texts of the sample, the
#: ``_MOST_COMMON`` first. They only order the shingles; every order gives the same pairs.
_SAMPLE, _COMMON, _MOST_COMMON = 8, 4, 1 << 18
_CHUNK = 1 << 16
#: Each round draws so many times as many texts to compare with as the one before.
_GROWTH = 8
#: Words of 64 bits in a sketch.
_SKETCH = 8
#: Bits of the filter that saves moving texts no pair asks for: 4 MB, whatever the corpus.
_FILTER = 1 << 25


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of every run of ``size`` lower-cased (A-Z) words; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]


def fingerprint(hashes: list[int], families: int = 1) -> list[int]:
    """Per family the bits set in more than half of the hashes, zero if there are none.

    The first family takes the hashes as they are, the others mix them anew.
    """
    counts = np.zeros((families, 64), dtype=np.int64)
    for a in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[a : a + _CHUNK], dtype="<u8")
        for family in range(families):
            bits = _mixed(part, family).view(np.uint8).reshape(-1, 8)
            counts[family] += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = 2 * counts > len(hashes)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def _mixed(hashes: np.ndarray, family: int) -> np.ndarray:
    if not family:
        return hashes
    x = hashes + np.uint64((family * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype("<u8")


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, families: int = 1
) -> DataFrame:
    """(doc_id, fingerprints: one signed long per family) of every row; null texts count as empty."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = T.StructType(
        [narrow.schema["doc_id"], T.StructField("fingerprints", T.ArrayType(T.LongType()))]
    )

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [fingerprint(shingle_hashes(t, shingle), families) for t in text_bytes(batch.column("text"))]
            values = np.array(found, dtype=np.uint64).reshape(-1).view(np.int64)
            ends = np.arange(len(found) + 1, dtype=np.int32) * families
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=schema.names)

    return narrow.mapInArrow(compute, schema)


def _half(half: int) -> Column:
    """A half of the fingerprint, with its number and the family above it."""
    value = F.shiftrightunsigned("fingerprint", 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
    place = F.shiftleft(2 * F.col("family").cast("long") + half, 32)
    return value.bitwiseOR(place)


def _flipped(half: Column, mask: Column) -> Column:
    return half.bitwiseXOR(mask)


def _variants(radius: int) -> list[Column]:
    """Per half all values within ``radius`` (0 or 1) bits."""
    masks = F.array(*(F.lit(m).cast("long") for m in [0] + [1 << i for i in range(32 * radius)]))
    return [F.transform(masks, functools.partial(_flipped, _half(h))) for h in (0, 1)]


def linked_pairs(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a, b) of ``node`` whose fingerprints differ in at most ``radius`` (0 to 3) bits.

    ``distinct`` has one row (family, fingerprint, node) per fingerprint.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the radius is 0 to 3 bits")
    halves = [_half(0), _half(1)]
    emitted = distinct.select(
        F.col("fingerprint").alias("from"), F.col("node").alias("a"), F.explode(F.concat(*_variants(radius // 2))).alias("variant")
    )
    centres = distinct.select(
        F.col("fingerprint").alias("to"),
        F.col("node").alias("b"),
        F.explode(F.array(*halves)).alias("variant"),
    )
    near = F.bit_count(F.col("from").bitwiseXOR(F.col("to"))) <= radius
    return (
        emitted.join(centres, (emitted["variant"] == centres["variant"]) & (F.col("from") < F.col("to")) & near)
        .select("a", "b")
        .distinct()
    )


def _classes(prints: DataFrame) -> DataFrame:
    """Rows with the same fingerprints are one class, named by its least id."""
    return stored(
        prints.filter("doc_id IS NOT NULL").groupBy("fingerprints").agg(F.min("doc_id").alias("node")), "classes"
    )


def _each(classes: DataFrame) -> DataFrame:
    return classes.select("node", F.posexplode("fingerprints").alias("family", "fingerprint"))


def _with_components(prints: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    named = classes.join(connected_components(links), "node", "left").select(
        "fingerprints", F.coalesce("component", "node").alias("component_id")
    )
    return prints.join(named, "fingerprints", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex(F.col("fingerprints")[0]), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, radius: int = 3
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    ``component_id`` is the least id reachable over links. Texts without words have fingerprint zero and are
    linked like any other. Every row is a document of its own, also if its id stands on other rows; rows
    without an id link nothing and have no component. Other columns are left out, whatever their names.
    """
    prints = stored(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    classes = _classes(prints)
    return _with_components(prints, classes, linked_pairs(_each(classes), radius))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(np.array(shingle_hashes(text, size), dtype=np.uint64))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each of the places, as 64-bit words."""
    places = (shingles >> np.uint64(55)).astype(np.int64)
    odd = np.bincount(places, minlength=64 * _SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _key(distinct: np.ndarray) -> int:
    """The key of a set of shingles, given in ascending order."""
    return xxhash.xxh64_intdigest(distinct.astype("<u8", copy=False).tobytes(), SEED)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _keyed(docs: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """(doc_id, fingerprint, key, sketch, text) of every row; texts with the same set of shingles have the same key."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = T.StructType(
        [
            narrow.schema["doc_id"],
            T.StructField("fingerprint", T.LongType()),
            T.StructField("key", T.LongType()),
            T.StructField("sketch", T.ArrayType(T.LongType())),
            narrow.schema["text"],
        ]
    )

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints, keys, sketches = [], [], []
            for text in text_bytes(batch.column("text")):
                hashes = shingle_hashes(text, shingle)
                distinct = np.unique(np.array(hashes, dtype="<u8"))
                prints += fingerprint(hashes)
                keys.append(_key(distinct))
                sketches.append(sketch(distinct))
            ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * _SKETCH)
            columns = [_signed(prints), _signed(keys), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sketches)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns, batch.column("text")], names=schema.names
            )

    return narrow.mapInArrow(compute, schema)


def _sampled() -> Column:
    return F.pmod(F.xxhash64("doc_id", "key"), F.lit(_SAMPLE)) == 0


def _common_shingles(keyed: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles, ascending, and in how many texts of the sample they are."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.concatenate([shingle_set(t, shingle) for t in text_bytes(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["token"])

    sample = keyed.filter(_sampled()).select("text")
    found = (
        sample.mapInArrow(compute, "token long")
        .groupBy("token")
        .count()
        .filter(F.col("count") >= _COMMON)
        .orderBy(F.desc("count"), "token")
        .limit(_MOST_COMMON)
        .toArrow()  # bounded by _MOST_COMMON
    )
    tokens = found.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found.column("count").to_numpy().astype(np.int64)[order]


def _prefixes(keyed: DataFrame, texts: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """(token, key, n_place) of the first shingles of every text, whose set has n; ``n_place`` holds n in its upper half and
    the place, from 0, in its lower one, which makes rows to shuffle a fifth shorter."""
    shared = keyed.sparkSession.sparkContext.broadcast(_common_shingles(keyed, shingle))
    schema = "token long, key long, n_place long"

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for batch in slices(batches, "text"):
            firsts, sizes, keys = [], [], []
            for text in text_bytes(batch.column("text")):
                tokens = shingle_set(text, shingle)
                many = np.zeros(len(tokens), dtype=np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
                    many = np.where(common[at] == tokens, counts[at], 0)
                # those behind are fewer than similar sets have in common
                first = min(len(tokens), len(tokens) + -similarity * len(tokens) // 100 + 1)
                firsts.append(tokens[np.lexsort((tokens, many))[:first]])
                sizes.append(len(tokens))
                keys.append(_key(tokens))
            taken = np.array([len(f) for f in firsts])
            places = np.concatenate([np.arange(k, dtype=np.int64) for k in taken])
            columns = [
                np.concatenate(firsts).view(np.int64),
                np.repeat(np.array(keys, dtype=np.uint64).view(np.int64), taken),
                (np.repeat(np.array(sizes, dtype=np.int64), taken) << 32) + places,
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "key", "n_place"])

    return texts.select("text").mapInArrow(compute, schema)


def _meetings(keyed: DataFrame, texts: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """(token, key, n, place, lead) where several keys meet in a first shingle; ``lead`` is the least of them."""
    meeting = W.partitionBy("token")
    met = (
        _prefixes(keyed, texts, shingle, similarity)
        .withColumn("lead", F.min(F.struct("key", "n_place")).over(meeting))
        .withColumn("_last", F.max("key").over(meeting))
        .filter("lead.key < _last")
        .select("token", "key", "n_place", "lead")
        .distinct()
    )
    lead = F.struct("lead.key", *_n_and_place(F.col("lead.n_place")))
    return met.select("token", "key", *_n_and_place(F.col("n_place")), lead.alias("lead"))


def _n_and_place(both: Column) -> tuple[Column, Column]:
    return F.shiftright(both, 32).cast("int").alias("n"), both.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("place")


def _may_be_similar(n: Column, place: Column, m: Column, other: Column, similarity: int) -> Column:
    """Whether sets of n and m shingles whose first common one is at these places can be as similar as asked.

    Holds for every similar pair at its first common shingle.
    """
    rest = F.least(n - place, m - other).cast("long")
    near = 100 * F.least(n, m).cast("long") >= similarity * F.greatest(n, m).cast("long")
    return near & ((100 + similarity) * rest >= similarity * (n.cast("long") + m))


def _within_sketches(n: Column, m: Column, one: Column, other: Column, similarity: int) -> Column:
    """Whether sets of n and m shingles with these sketches can be as similar as asked."""
    apart = functools.reduce(Column.__add__, (F.bit_count(one[i].bitwiseXOR(other[i])) for i in range(_SKETCH)))
    return (100 + similarity) * apart.cast("long") <= (100 - similarity) * (n.cast("long") + m)


def _texts_of(pairs: DataFrame, keyed: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(key, text) of the keys of ``pairs``, once each. A filter of fixed size keeps most other texts out of the shuffle."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    bearers = needed.join(keyed.select("key", "doc_id"), "key").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(_FILTER))
    words = (
        bearers.select(bit.alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        .toArrow()  # bounded by _FILTER
    )
    filled = np.zeros(_FILTER // 64, dtype=np.int64)
    filled[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = keyed.sparkSession.sparkContext.broadcast(filled)
    schema = T.StructType([T.StructField("key", T.LongType()), texts.schema["text"]])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            at = big.column("bit").to_numpy()
            asked = shared.value[at >> 6] >> (at & 63) & 1
            for batch in slices([big.filter(pa.array(asked.astype(bool)))], "text"):
                keys = [_key(shingle_set(t, shingle)) for t in text_bytes(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([_signed(keys), batch.column("text")], names=schema.names)

    asked = texts.select(bit.alias("bit"), "text").mapInArrow(likely, schema)
    return asked.join(needed, "key", "left_semi").dropDuplicates(["key"])


def _verified(pairs: DataFrame, keyed: DataFrame, texts: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """The stored pairs (a, b, ...) of keys whose texts have the Jaccard similarity."""
    columns = pairs.columns

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[bytes, np.ndarray] = (b"", shingle_set(b"", shingle))
        for big in batches:
            for batch in slices(slices([big], "x"), "y"):
                good = []
                for x, y in zip(text_bytes(batch.column("x")), text_bytes(batch.column("y"))):
                    if known[0] != y:
                        known = (y, shingle_set(y, shingle))
                    one, other = shingle_set(x, shingle), known[1]
                    both = len(np.intersect1d(one, other, assume_unique=True))
                    good.append(100 * both >= similarity * (len(one) + len(other) - both))
                yield batch.select(columns).filter(pa.array(good, pa.bool_()))

    asked = _texts_of(pairs, keyed, texts, shingle)  # shuffled once for both sides
    a = asked.select(F.col("key").alias("a"), F.col("text").alias("x"))
    b = asked.select(F.col("key").alias("b"), F.col("text").alias("y"))
    return pairs.join(a, "a").join(b, "b").select(*columns, "x", "y").mapInArrow(compute, pairs.schema)


def similar_links(keyed: DataFrame, shingle: int, similarity: int, texts: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between keys: what similar pairs connect is connected by them, and nothing else.

    ``texts`` has the rows (doc_id, text) of ``keyed``, if that one has only those of the sample. It is read several times.
    """
    texts = keyed.select("doc_id", "text") if texts is None else texts
    meetings = stored(_meetings(keyed, texts, shingle, similarity), "meetings")
    sketches = stored(keyed.select("key", "sketch").dropDuplicates(["key"]), "sketches")
    stars = (
        meetings.filter("lead.key < key")
        .filter(_may_be_similar(F.col("n"), F.col("place"), F.col("lead.n"), F.col("lead.place"), similarity))
        .select(F.col("key").alias("a"), F.col("lead.key").alias("b"), "n", F.col("lead.n").alias("m"))
        .distinct()
        .join(sketches.select(F.col("key").alias("a"), F.col("sketch").alias("one")), "a")
        .join(sketches.select(F.col("key").alias("b"), F.col("sketch").alias("other")), "b")
        .filter(_within_sketches(F.col("n"), F.col("m"), F.col("one"), F.col("other"), similarity))
        .select("a", "b")
    )
    stars = stored(stars, "stars")
    links = connected_components(stored(_verified(stars, keyed, texts, shingle, similarity), "star-links"))
    links = stored(links.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")), "star-groups")
    grouped = meetings.drop("lead").join(links.select(F.col("a").alias("key"), F.col("b").alias("component")), "key", "left")
    mixed = stored(_mixed_meetings(grouped.withColumn("component", F.coalesce("component", "key"))), "mixed-meetings")
    return links.union(_joined_groups(mixed, sketches, stars, keyed, texts, shingle, similarity))


def _mixed_meetings(grouped: DataFrame) -> DataFrame:
    """The meetings of several groups; ``few`` are those outside the largest group that meets in their shingle, ``crowded``
    those in shingles of more than ``_GROWTH`` texts."""
    texts, group = W.partitionBy("token"), W.partitionBy("token", "component")
    counted = grouped.repartition("token").withColumn("_size", F.count("*").over(group))
    top = F.max(F.struct("_size", "component")).over(texts)["component"]
    return (
        counted.withColumn("crowded", F.count("*").over(texts) > _GROWTH)
        .withColumn("few", F.col("component") != top)
        .withColumn("_least", F.min("component").over(texts))
        .withColumn("_most", F.max("component").over(texts))
        .filter("_least < _most")
        .drop("_size", "_least", "_most")
    )


def _shares(mixed: DataFrame) -> list[int]:
    """One in so many texts is drawn in each round: a few of the largest meeting first, all of them at last."""
    largest = mixed.groupBy("token").count().agg(F.max("count")).first()[0]
    shares = [1] if largest else []
    while shares and shares[0] * _GROWTH < largest:
        shares.insert(0, shares[0] * _GROWTH)
    return shares


def _untested(mixed: DataFrame, share: int, before: int | None, similarity: int) -> DataFrame:
    """Pairs (a, b, of_a, of_b) that meet, may be similar, are in different groups, and of which at least one text is
    drawn now and none was drawn before."""
    draw = F.xxhash64("key")
    left = mixed if before is None else mixed.filter(F.pmod(draw, F.lit(before)) != 0)
    drawn = left.filter(F.pmod(draw, F.lit(share)) == 0)
    # two texts of the largest group never differ, so its texts meet only those of the few
    few = _met(left.filter("few"), drawn, similarity)
    return few.union(_met(left.filter("NOT few"), drawn.filter("few"), similarity)).distinct()


def _met(some: DataFrame, centres: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b, of_a, of_b), a above b, of different groups that meet and may be similar."""
    names = {"token": "at", "key": "centre", "n": "m", "place": "other", "component": "own", "sketch": "with"}
    centres = centres.select(*names).withColumnsRenamed(names)
    fits = (
        (F.col("token") == F.col("at"))
        & (F.col("component") != F.col("own"))
        & _may_be_similar(F.col("n"), F.col("place"), F.col("m"), F.col("other"), similarity)
        & _within_sketches(F.col("n"), F.col("m"), F.col("sketch"), F.col("with"), similarity)
    )
    drawn_first = F.col("centre") > F.col("key")
    return some.select(*names).join(centres, fits).select(
        F.greatest("centre", "key").alias("a"),
        F.least("centre", "key").alias("b"),
        F.when(drawn_first, F.col("own")).otherwise(F.col("component")).alias("of_a"),
        F.when(drawn_first, F.col("component")).otherwise(F.col("own")).alias("of_b"),
    )


def _joined_groups(
    mixed: DataFrame, sketches: DataFrame, tested: DataFrame, keyed: DataFrame, texts: DataFrame, shingle: int, similarity: int
) -> DataFrame:
    """Links (a, b) between groups, named by their least key, that similar pairs which meet in ``mixed`` connect."""
    found = keyed.sparkSession.createDataFrame([], "a long, b long")

    def merge(pairs: DataFrame) -> DataFrame:
        good = _verified(pairs, keyed, texts, shingle, similarity)
        merged = good.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
        renamed = connected_components(stored(merged, "merged-groups")).filter("node <> component")
        return stored(renamed.select(F.col("node").alias("a"), F.col("component").alias("b")), "renamed-groups")

    def regrouped(mixed: DataFrame, renamed: DataFrame) -> DataFrame:
        name = renamed.select(F.col("a").alias("component"), F.col("b").alias("renamed"))
        grouped = mixed.drop("few", "crowded").join(name, "component", "left")
        return _mixed_meetings(grouped.withColumn("component", F.coalesce("renamed", "component")).drop("renamed"))

    crowded, before = stored(mixed.filter("crowded").join(sketches, "key"), "crowded-meetings"), None
    for share in _shares(crowded):
        pairs = stored(_untested(crowded, share, before, similarity).join(tested, ["a", "b"], "left_anti"), "untested")
        before = share
        if pairs.isEmpty():
            continue
        tested = tested.union(pairs.select("a", "b"))
        renamed = merge(pairs)
        found = found.union(renamed)
        if share > 1 and not renamed.isEmpty():
            crowded = stored(regrouped(crowded, renamed), "crowded-meetings")
    groups = connected_components(found).filter("node <> component")
    others = regrouped(mixed.filter("NOT crowded"), groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
    others = others.join(sketches, "key")
    pairs = _met(others, others, similarity).distinct().join(tested, ["a", "b"], "left_anti")
    pairs = stored(pairs, "untested")
    return found if pairs.isEmpty() else found.union(merge(pairs))


def similar_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 5,
    similarity: int = SIMILARITY,
) -> DataFrame:
    """As ``near_duplicates``, for a Jaccard similarity of the word shingles of ``similarity`` percent and more.

    ``docs`` is read several times: hand over a stored table.
    """
    if not 1 <= similarity <= 100:
        raise ValueError("the similarity is 1 to 100 percent")
    keyed = _keyed(docs, id_column, text_column, shingle)
    keyed = stored(keyed.withColumn("text", F.when(_sampled(), F.col("text"))), "keyed")
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    known, texts = (d.filter("doc_id IS NOT NULL") for d in (keyed, texts))
    links = similar_links(known, shingle, similarity, texts)
    classes = known.groupBy("key").agg(F.min("doc_id").alias("least"))
    grouped = classes.join(connected_components(links).withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    grouped = stored(grouped, "groups")
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(named, "component").select("key", "component_id")
    return keyed.drop("text").join(named, "key", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def drop_similar(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how: int) -> DataFrame:
    """The rows, with all their columns, whose id is the smallest of its group.

    The groups are those of ``near_duplicates`` and of ``similar_documents`` (with ``how``), united where they share an id:
    fingerprints miss similar texts that differ in a few words, and near fingerprints may stand on texts that are less similar.
    Rows without an id stay. Rows that share an id stay or go together.
    """
    near = near_duplicates(docs, id_column, text_column)
    similar = similar_documents(docs, id_column, text_column, **how)
    links = near.union(similar).filter("component_id < doc_id").selectExpr("doc_id AS a", "component_id AS b")
    groups = connected_components(stored(links, "links-of-both"))
    dropped = stored(groups.filter("component < node").select(F.col("node").alias("_dropped")).distinct(), "dropped")
    return docs.join(dropped, F.col(id_column) == F.col("_dropped"), "left_anti")
