"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: the mix has a given share of all tokens; sources share it by weight, no source beyond a limit of
times its own size, and what a limit cuts off goes to the others by weight. Apportionment: the blocks
of the mix are seats, awarded by the highest quotients target / (2 k + 1); because this method never takes a
seat back as the house grows, the seats of any run of shards are differences of two apportionments, which
gives integer quotas per shard. Selection: the documents of a source lie in a seeded order on a line
of tokens, which is cut into equal blocks; a shard takes the next blocks of its quota, from a seeded
block on and around the end, so a source repeats only after all of it was taken once.

Everything is native: quotas are closed forms over one row per source, and what a document gives is the
overlap of its place on the line with one interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from apilens.llm.common import WORD, stored

WEIGHTS = (3, 1, 2)
BLOCK_TOKENS = 32
SHARDS = 8
#: Parts of a source within which places are summed before they are summed across parts.
PARTS = 1024


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add ``weight`` and ``target`` to (source, source_size).

    Sources by code point, null last, take the weights in turn. The level at which weights are paid
    rises until the whole share is placed; sources stop at ``most`` times their size in the order of size to
    weight, so the level follows from running sums. The table has one row per source.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
    weighted = sources.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (turn - 1) % len(weights) + 1).cast("double")
    ).withColumn("limit", F.col("source_size").cast("double") * most)
    by_fill = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    from_here = by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (
        F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    ) / F.sum("weight").over(from_here)
    # a source below its limit sees the final level first; those behind it see at least that level
    return (
        weighted.withColumn("level", level)
        .withColumn("below", F.col("level") * F.col("weight") <= F.col("limit"))
        .withColumn("final", F.min(F.when(F.col("below"), F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(everything))
        .withColumn("target", F.least(F.col("limit"), F.coalesce(F.col("final.level") * F.col("weight"), F.col("limit"))))
        .select("source", "source_size", "weight", "target")
    )


def apportion(votes: DataFrame, houses: DataFrame) -> DataFrame:
    """Seats (key, house, seats) of every key in ``votes`` (key, votes) for each of ``houses`` (house, size).

    Sainte-Laguë, ties to the smaller key. With k keys a house of n seats ends between the divisors of
    n - k/2 and n + k/2: the seats below the first are certain, and only the about 2 k quotients between both
    are ranked. Both tables are small: one row per key, one per house.
    """
    counted = votes.select("key", F.col("votes").cast("double")).withColumns(
        {"total": F.sum("votes").over(W.partitionBy()), "keys": F.count("*").over(W.partitionBy())}
    )
    each = counted.join(houses, F.col("votes") > 0)
    certain = F.floor(F.greatest(F.lit(0.0), F.col("size") - F.col("keys") / 2 - 1) * F.col("votes") / F.col("total") + 0.5)
    possible = F.floor((F.col("size") + F.col("keys") / 2 + 1) * F.col("votes") / F.col("total") + 0.5)
    bounds = each.withColumns({"certain": certain, "possible": possible})
    left = bounds.groupBy("house").agg((F.first("size") - F.sum("certain")).alias("left"))
    ranked = (
        bounds.filter("possible > certain")
        .withColumn("k", F.explode(F.sequence(F.col("certain"), F.col("possible") - 1)))
        .withColumn("rank", F.row_number().over(W.partitionBy("house").orderBy((F.col("votes") / (2 * F.col("k") + 1)).desc(), "key", "k")))
        .join(left, "house")
        .filter("rank <= left")
        .groupBy("house", "key")
        .agg(F.count("*").alias("more"))
    )
    return bounds.join(ranked, ["house", "key"], "left").select(
        "key", "house", (F.col("certain") + F.coalesce("more", F.lit(0))).alias("seats")
    )


def shard_quotas(sources: DataFrame, block_tokens: int = BLOCK_TOKENS, shards: int = SHARDS) -> DataFrame:
    """(source_key, shard, first_seat, quota): the blocks of each source in each shard, in integer numbers.

    ``sources`` has (source_key, target).
    """
    blocks = F.round(F.sum("target") / block_tokens)
    houses = sources.agg(blocks.alias("blocks")).select(
        F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("house"), "blocks"
    ).select("house", F.floor(F.col("blocks") * F.col("house") / shards).alias("size"))
    seats = apportion(sources.select(F.col("source_key").alias("key"), F.col("target").alias("votes")), houses)
    before = F.coalesce(F.lag("seats").over(W.partitionBy("key").orderBy("house")), F.lit(0))
    return seats.select(
        F.col("key").alias("source_key"),
        (F.col("house") - 1).alias("shard"),
        before.alias("first_seat"),
        (F.col("seats") - before).alias("quota"),
    )


def _places(sized: DataFrame, seed: int) -> DataFrame:
    """Where every row begins on the line of its source: seeded parts first, then ids inside a part."""
    # only repeated rows, which may change places, are told apart by their numbers
    order = F.xxhash64(F.lit(seed), "doc_id", "text_hash")
    rows = sized.select("*", order.alias("order"), F.pmod(order, F.lit(PARTS)).alias("part"))
    inside = W.partitionBy("source_key", "part").orderBy("order", "doc_id", "text_hash", "row")
    across = W.partitionBy("source_key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("source_key", "part").agg(F.sum("size").alias("n"))
    bases = parts.withColumn("base", F.coalesce(F.sum("n").over(across), F.lit(0))).drop("n")
    placed = rows.withColumn("at", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    return placed.join(bases, ["source_key", "part"]).withColumn("at", F.col("at") + F.col("base")).drop("order", "part", "base")


def mix(
    docs: DataFrame,
    share: float = 1.5,
    most: int = 2,
    block_tokens: int = BLOCK_TOKENS,
    shards: int = SHARDS,
    seed: int = 7,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """What the mix takes of every row.

    (doc_id, source, row, text_hash, size, source_size, target, taken, copies, from_word, to_word): ``copies`` whole
    copies and, if ``from_word < to_word``, those words once more; ``wraps`` marks the only document of a source
    whose extra words are all but [from_word, to_word). ``row`` numbers rows, so repeated rows and rows without an
    id are rows of their own. Null texts have size 0; sources without words take nothing; an empty table gives
    an empty result.
    """
    sized = stored(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(source_column).alias("source"),
            # the empty source and the missing one are two sources
            F.concat(F.lit("="), source_column).alias("known"),
            size_of(F.col(text_column)).alias("size"),
            F.xxhash64(text_column).alias("text_hash"),
            F.monotonically_increasing_id().alias("row"),
        ).select("doc_id", "source", F.coalesce("known", F.lit("-")).alias("source_key"), "size", "text_hash", "row"),
        "sizes",
    )
    totals = sized.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    sources = stored(
        targets(totals.select("source", "source_size"), share, most).withColumn(
            "source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
        ),
        "sources",
    )
    quotas = shard_quotas(sources, block_tokens, shards).groupBy("source_key").agg(F.sum("quota").alias("blocks"))
    size = F.col("source_size")
    wanted = F.least(F.coalesce("blocks", F.lit(0)) * block_tokens, size * most)
    plan = (
        sources.join(quotas, "source_key", "left")
        .withColumn("wanted", wanted.cast("long"))
        .withColumn("passes", F.when(size > 0, F.floor(F.col("wanted") / size)).otherwise(0))
        .withColumn("extra", F.when(size > 0, F.col("wanted") % size).otherwise(0))
        .withColumn("n_blocks", F.greatest(F.lit(1), F.floor(size / block_tokens)))
        .withColumn("begin", F.pmod(F.xxhash64(F.lit(seed), "source_key"), F.col("n_blocks")) * block_tokens)
        .withColumn("end", F.col("begin") + F.col("extra"))
        .select("source_key", "source_size", "target", "passes", "begin", "end")
    )
    placed = _places(sized, seed).join(stored(plan, "mix-plan"), "source_key")
    first, last = F.col("at"), F.col("at") + F.col("size")

    def overlap(a: Column, b: Column) -> tuple[Column, Column]:
        low = F.least(F.greatest(a, first), last)
        return low - first, F.greatest(low, F.least(b, last)) - first

    # the interval of extra words may run over the end of the line
    a1, b1 = overlap(F.col("begin"), F.least("end", "source_size"))
    a2, b2 = overlap(F.lit(0), F.greatest(F.lit(0), F.col("end") - F.col("source_size")))
    cut = placed.withColumns({"a1": a1, "b1": b1, "a2": a2, "b2": b2})
    both = (F.col("b1") > F.col("a1")) & (F.col("b2") > F.col("a2"))
    return cut.select(
        "doc_id",
        "source",
        "row",
        "text_hash",
        "size",
        "source_size",
        "target",
        (F.col("passes") * F.col("size") + F.col("b1") - F.col("a1") + F.col("b2") - F.col("a2")).cast("long").alias("taken"),
        F.col("passes").cast("int").alias("copies"),
        F.when(both, F.col("b2")).when(F.col("b1") > F.col("a1"), F.col("a1")).otherwise(F.col("a2")).alias("from_word"),
        F.when(both, F.col("a1")).when(F.col("b1") > F.col("a1"), F.col("b1")).otherwise(F.col("b2")).alias("to_word"),
        both.alias("wraps"),
    )


def mixed_documents(
    docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", **how: object
) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: a row per whole copy, and for the at most two documents
    of a source at the ends of its extra words a row with those words, joined by single spaces."""
    plan = mix(docs, id_column=id_column, source_column=source_column, text_column=text_column, **how)
    plan = stored(plan.filter("taken > 0"), "mix").select(
        F.col("doc_id").alias("_id"),
        F.col("text_hash").alias("_hash"),
        F.row_number().over(W.partitionBy("doc_id", "text_hash").orderBy("row")).alias("_n"),
        "row", "size", "copies", "from_word", "to_word", "wraps",
    )
    plan = plan.select(F.struct(*(c for c in plan.columns if c[0] != "_")).alias("_mix"), "_id", "_hash", "_n")
    key = [F.col(id_column), F.xxhash64(text_column)]
    # only where rows repeat id and text have they to be told apart
    repeats = not plan.filter("_n > 1").isEmpty()
    number = F.row_number().over(W.partitionBy(*key).orderBy(id_column)) if repeats else F.lit(1)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), number.alias("_m"))
    text = F.col("_doc").getField(text_column)
    taken = rows.join(
        plan,
        F.col("_doc").getField(id_column).eqNullSafe(F.col("_id"))
        & (F.xxhash64(text) == F.col("_hash"))
        & (F.col("_m") == F.col("_n")),
    )
    m = F.col("_mix")
    extra = m["to_word"] > m["from_word"]
    whole = ~m["wraps"] & (m["from_word"] == 0) & (m["to_word"] == m["size"])
    copies = F.concat(
        F.array_repeat(F.lit(True), m["copies"]), F.when(extra, F.array(whole)).otherwise(F.array().cast("array<boolean>"))
    )
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    inner = F.slice(words, m["from_word"] + 1, m["to_word"] - m["from_word"])
    outer = F.concat(F.slice(words, F.lit(1), m["from_word"]), F.slice(words, m["to_word"] + 1, m["size"]))
    part = F.array_join(F.when(m["wraps"], outer).otherwise(inner), " ")
    return taken.withColumn("_whole", F.explode(copies)).select(
        *(
            F.when(F.col("_whole"), text).otherwise(part).alias(c) if c == text_column else F.col("_doc").getField(c).alias(c)
            for c in docs.columns
        )
    )
