"""Sharding by sampled splitters: near equal bytes, equal texts side by side.

Rows lie on a line ordered by (hash of the text, hash of the id). A size-weighted sample of that line is drawn, its
quantiles are the boundaries of many narrow ranges, the exact size of every range is counted, and ranges that came
out too large are sampled and divided again. A shard is a run of neighbouring ranges, cut where its share of
all bytes is full. Everything is DataFrame code; no order and no text reaches the driver.

- A range ends between two groups of equal texts, so a group stays in one shard; only a group that is itself larger than
  a range is divided, by ids, and rows that are the same in text and id by number.
- Draws depend on hashes of text and id alone: other partitionings and retried tasks give the same shards.
- Rows are narrow here (about 50 bytes); sizes are summed per (text, id) before anything is shuffled by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from apilens.llm.common import stored

SHARDS = 16
#: Ranges per shard. A shard differs from its share by half a range on either side.
RANGES_PER_SHARD = 64
#: Draws per range.
OVERSAMPLING = 8
#: Ranges of more than this many times the intended bytes are divided again.
TOO_LARGE = 2
#: Rows that are the same in text and id are handled in runs of at most so many.
LONGEST_RUN = 1 << 20

#: The top bits of a hash: ranges are listed under the cells they touch, so that a row meets the few ranges of its cell.
_CELL_BITS = 12
_LEAST, _GREATEST = -(1 << 63), (1 << 63) - 1


def _point(*names: str) -> Column:
    return F.struct(*(F.col(n) for n in names))


def _cell(key: Column) -> Column:
    return F.shiftright(key, 64 - _CELL_BITS)


def _items(docs: DataFrame, id_column: str, text_column: str, ranges: int) -> DataFrame:
    """(key, tie, run, doc_id, size, text_crc32, copies): one row per text and id, in runs if it is repeated often."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.xxhash64(text).alias("key"),
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    records = rows.groupBy("key", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    records = stored(records.withColumn("tie", F.xxhash64("doc_id", "text_crc32")), "shard-records")
    # a record of more bytes than a range becomes several items
    ideal = F.greatest(F.lit(1), F.floor(records.select(F.sum(F.col("n") * F.col("size"))).scalar() / ranges))
    longest = F.greatest(F.lit(1), F.least(F.lit(LONGEST_RUN), F.floor(ideal / F.col("size")))).cast("long")
    runs = F.ceil(F.col("n") / longest)
    split = records.withColumn("longest", longest).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), runs - 1)))
    copies = F.least(F.col("longest"), F.col("n") - F.col("run") * F.col("longest"))
    return stored(split.select("key", "tie", "run", "doc_id", "size", "text_crc32", copies.alias("copies")), "shard-items")


def _drawn(items: DataFrame, total: Column, draws: Column, seed: int) -> DataFrame:
    """Items with the number of ``draws`` that fall on them; ``total`` are the bytes that share the draws.

    An item of w bytes gets w * draws / total of them, rounded up or down by its hash, so the sample has
    about ``draws`` rows however large the input is.
    """
    unit = F.pmod(F.xxhash64(F.lit(seed), "key", "tie", "run"), F.lit(1 << 30)) / (1 << 30)
    drawn = F.floor(F.col("copies") * F.col("size") * draws / total + unit)
    return items.withColumn("drawn", drawn.cast("long")).filter("drawn > 0")


def _boundaries(sample: DataFrame, within: str) -> DataFrame:
    """Quantiles of the sample of every range ``within``: (lo_key, lo_tie, lo_run), where the next range begins.

    Only if two quantiles fall on one text does the boundary stay inside its group.
    """
    line = W.partitionBy(within).orderBy("key", "tie", "run")
    upto = F.sum("drawn").over(line.rowsBetween(W.unboundedPreceding, 0))
    marks = (
        sample.withColumn("upto", upto)
        .filter(F.floor(F.col("upto") / OVERSAMPLING) > F.floor((F.col("upto") - F.col("drawn")) / OVERSAMPLING))
        .withColumn("on_text", F.count("*").over(W.partitionBy(within, "key")))
    )
    inner = F.col("on_text") > 1
    heavy = F.col("drawn") >= OVERSAMPLING
    begin = _boundary(F.col("key"), F.when(inner, F.col("tie")), F.when(inner, F.col("run")))
    # an item as large as a range is one by itself
    behind = F.when(heavy & inner, _boundary(F.col("key"), F.col("tie"), F.col("run") + 1)).when(
        heavy & (F.col("key") < F.lit(_GREATEST)), _boundary(F.col("key") + 1, F.lit(None), F.lit(None))
    )
    found = marks.select(F.explode(F.array_compact(F.array(begin, behind))).alias("lo"))
    return found.select("lo.*").distinct()


def _boundary(key: Column, tie: Column, run: Column) -> Column:
    least = F.lit(_LEAST)
    return F.struct(
        key.alias("lo_key"), F.coalesce(tie, least).alias("lo_tie"), F.coalesce(run, least).alias("lo_run")
    )


def _ranges(boundaries: DataFrame) -> DataFrame:
    """(range, lo, hi, cell) of neighbouring boundaries, a row per cell that the range touches.

    There are at most some ``2 * ranges`` boundaries and ``2 ** _CELL_BITS`` cells, whatever the input.
    """
    line = W.orderBy("lo_key", "lo_tie", "lo_run")
    lo = _point("lo_key", "lo_tie", "lo_run")
    found = boundaries.select(
        F.row_number().over(line).alias("range"), lo.alias("lo"), F.lead(lo).over(line).alias("hi")
    )
    last = F.coalesce(_cell(F.col("hi.lo_key")), F.lit((1 << (_CELL_BITS - 1)) - 1).cast("long"))
    return found.withColumn("cell", F.explode(F.sequence(_cell(F.col("lo.lo_key")), last)))


def _placed(items: DataFrame, ranges: DataFrame) -> DataFrame:
    """Items with the number of their range: an equi join by cell, then the two bounds."""
    at = F.struct(F.col("key").alias("lo_key"), F.col("tie").alias("lo_tie"), F.col("run").alias("lo_run"))
    inside = (at >= F.col("lo")) & (F.col("hi").isNull() | (at < F.col("hi")))
    return items.join(
        F.broadcast(ranges), (_cell(F.col("key")) == F.col("cell")) & inside  # a bounded number of boundaries
    ).drop("lo", "hi", "cell")


def _sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("range").agg(
        F.sum(F.col("copies") * F.col("size")).alias("bytes"),
        F.sum("copies").alias("rows"),
        F.count("*").alias("items"),
    )


def assign(
    docs: DataFrame,
    shards: int = SHARDS,
    ranges_per_shard: int = RANGES_PER_SHARD,
    seed: int = 11,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, range) of every row.

    ``size`` is the UTF-8 length of the text and one. The law is ``bytes``: the sizes of the shards are
    equal up to a range, which is 1 / ``ranges_per_shard`` of a shard or one long text. ``slot`` numbers the
    rows of a shard from 0 without gaps. ``grown_shard`` is null, as another number of shards has other
    boundaries.

    Null texts count as empty. Rows that are the same in id and text are rows of their own, with slots of their own;
    rows without an id take part like all others. Fewer rows than shards leave shards empty; an empty table gives
    an empty result. Other columns are left out, whatever their names.
    """
    if shards < 1 or ranges_per_shard < 1:
        raise ValueError("at least one shard and one range a shard are needed")
    wanted = shards * ranges_per_shard
    items = _items(docs, id_column, text_column, wanted)
    total = items.select(F.sum(F.col("copies") * F.col("size"))).scalar()
    draws = F.lit(wanted * OVERSAMPLING)
    start = items.sparkSession.range(1).select(*(F.lit(_LEAST).alias(n) for n in ("lo_key", "lo_tie", "lo_run")))
    sample = _drawn(items, total, draws, seed).withColumn("all", F.lit(0))
    boundaries = stored(_boundaries(sample, "all").union(start).distinct(), "boundaries")
    placed = stored(_placed(items, _ranges(boundaries)), "placed")
    sizes = stored(_sizes(placed), "range-sizes")
    ideal = total / wanted
    overfull = (F.col("bytes") > ideal * TOO_LARGE) & (F.col("items") > 1)
    for again in range(1, 64):
        large = sizes.filter(overfull).select("range", "bytes")
        if large.isEmpty():
            break
        # each overfull range is sampled like the whole was, as if it alone were to be divided
        inner = placed.join(F.broadcast(large), "range")  # at most 1 / TOO_LARGE of the intended number of ranges
        share = F.ceil(F.col("bytes") / ideal) * OVERSAMPLING
        more = _boundaries(_drawn(inner, F.col("bytes"), share, seed + again), "range")
        finer = stored(boundaries.union(more).distinct(), "boundaries")
        if finer.count() == boundaries.count():
            break  # what is left is one group of colliding hashes
        boundaries = finer
        placed = stored(_placed(items, _ranges(boundaries)), "placed")
        sizes = stored(_sizes(placed), "range-sizes")
    # ranges to shards: by where the middle of a range lies on the line of bytes
    line = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("bytes").over(line), F.lit(0))
    everything = F.sum("bytes").over(W.partitionBy())
    middle = (before + F.col("bytes") / 2) * shards / everything
    in_shard = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    plan = stored(
        sizes.withColumn("shard", F.least(F.floor(middle), F.lit(shards - 1)).cast("int")).select(
            "range", "shard", F.coalesce(F.sum("rows").over(in_shard), F.lit(0)).alias("base")
        ),
        "shard-plan",
    )
    inside = W.partitionBy("range").orderBy("key", "tie", "doc_id", "size", "text_crc32", "run")
    first = F.coalesce(F.sum("copies").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.withColumn("first", first).join(F.broadcast(plan), "range")  # one row per range
    return numbered.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    ).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("first") + F.col("copy")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "range",
    )


def write_shards(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", **how: int) -> DataFrame:
    """Write the rows with all their columns as Parquet under ``path`` and return the written table.

    The shard is a partition column named ``shard``, with underscores before it if ``docs`` has that column itself. Rows
    that are the same in id and text, and that a cut divides, are dealt over its shards by the hash of their place, so of those
    each shard gets about as many as it was assigned.
    """
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"),
        F.col(id_column).alias("_id"),
        F.octet_length(text).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        F.xxhash64(F.monotonically_increasing_id()).alias("_place"),
    )
    counts = assign(docs, id_column=id_column, text_column=text_column, **how).groupBy("doc_id", "size", "text_crc32", "shard").count()
    same = W.partitionBy("doc_id", "size", "text_crc32")
    upto = F.sum("count").over(same.orderBy("shard").rowsBetween(W.unboundedPreceding, 0))
    quotas = counts.withColumns({"upto": upto, "n": F.sum("count").over(same)})
    place = F.pmod(F.col("_place"), F.col("n"))
    dealt = rows.join(
        quotas,
        F.col("_id").eqNullSafe(F.col("doc_id"))
        & (F.col("_size") + 1 == F.col("size"))
        & (F.col("_crc") == F.col("text_crc32"))
        & (place < F.col("upto"))
        & (place >= F.col("upto") - F.col("count")),
    )
    out = dealt.select(*(F.col("_doc").getField(c).alias(c) for c in docs.columns), F.col("shard").alias(name), "_place")
    out.repartitionByRange(name, "_place").drop("_place").write.partitionBy(name).parquet(path)
    return docs.sparkSession.read.parquet(path)
