"""Table queries over keyed entities: lists, lookups, search, report, batch changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from apilens.staging import staged


#: Pieces a core into which rows are dealt before each becomes many.
_PIECES = 8


def list_with_count(table: DataFrame) -> DataFrame:
    """All rows, each with the number of rows; the list itself is never collected."""
    return table.withColumn("count", table.select(F.count("*")).scalar())


def orders_of_users(users: DataFrame, orders: DataFrame, ids: DataFrame) -> DataFrame:
    """For each asked ``user_id``: its orders with their number, or one row marked 404."""
    asked = ids.select("user_id").distinct()
    known = asked.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    counts = orders.groupBy("user_id").agg(F.count("*").alias("count"))
    answered = (
        known.join(counts, "user_id", "left")
        .join(
            orders.select("user_id", F.col("id").alias("order_id"), "total", "status"),
            "user_id",
            "left",
        )
        .select(
            "user_id",
            F.lit(200).alias("status_code"),
            F.coalesce("count", F.lit(0)).alias("count"),
            "order_id",
            "total",
            F.col("status").alias("order_status"),
        )
    )
    refused = unknown_users(users, ids).select("user_id", F.lit(404).alias("status_code"))
    return answered.unionByName(refused, allowMissingColumns=True)


def unknown_users(users: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("user_id").distinct().join(
        users.select(F.col("id").alias("user_id")), "user_id", "left_anti"
    )


def search(query: str, users: DataFrame, products: DataFrame) -> DataFrame:
    """Rows whose name (or a user's email) contains ``query``, case ignored, with the total."""
    if not query:
        raise ValueError("a query text is required")
    wanted = query.lower()
    hits = (
        users.filter(F.lower("name").contains(wanted) | F.lower("email").contains(wanted))
        .select(F.lit("user").alias("kind"), "id", "name")
        .unionByName(
            products.filter(F.lower("name").contains(wanted)).select(
                F.lit("product").alias("kind"), "id", "name"
            )
        )
    )
    return hits.withColumn("total_results", hits.select(F.count("*")).scalar())


def sales_report(orders: DataFrame) -> DataFrame:
    """Completed sales, pending orders, all orders; amounts are added as exact decimals."""
    amount = F.col("total").cast("decimal(28,2)")
    return orders.agg(
        F.coalesce(
            F.sum(F.when(F.col("status") == "completed", amount)).cast("double"), F.lit(0.0)
        ).alias("total_sales"),
        F.count_if(F.col("status") == "pending").alias("pending_orders"),
        F.count("*").alias("total_orders"),
    )


def _parts_of_length(text: Column, lengths: Column) -> Column:
    """Every part of ``text`` whose length is one of ``lengths``."""
    fitting = F.filter(lengths, lambda n: (n > 0) & (n <= F.length(text)))
    return F.flatten(
        F.transform(
            fitting,
            lambda n: F.transform(
                F.sequence(F.lit(1), F.length(text) - n + 1),
                lambda at: F.substring(text, at, n),
            ),
        )
    )


def order_user_details(orders: DataFrame, users: DataFrame) -> DataFrame:
    """For each order the first user whose name or email contains the customer's first word.

    "Contains" as an equi join: users are listed under every part of their name and email that is
    as long as some word asked for, reduced to the first user of each part. The work grows with the
    users' text, not with orders times users. An order without customer text asks for nothing.
    """
    word = F.lower(F.get(F.split(F.trim("customer"), r"\s+"), 0))
    asked = orders.select("id", "customer", F.nullif(word, F.lit("")).alias("word"))
    words = asked.select("word").filter(F.col("word").isNotNull()).distinct()
    lengths = words.select(F.collect_set(F.length("word")).alias("lengths"))
    texts = F.array_union(
        _parts_of_length(F.lower("name"), F.col("lengths")),
        _parts_of_length(F.lower("email"), F.col("lengths")),
    )
    # A user becomes a hundred parts and more: dealt to all tasks first, as a small table is read by few.
    dealt = users.select("id", "name", "email").repartition(_PIECES * users.sparkSession.sparkContext.defaultParallelism)
    first = (
        dealt.withColumn("lengths", lengths.scalar())
        .select("id", F.explode(texts).alias("word"))
        .join(words, "word", "left_semi")
        .groupBy("word")
        .agg(F.min("id").alias("user_id"))
    )
    names = users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    index = first.join(names, "user_id")
    return asked.join(index, "word", "left").select(
        F.col("id").alias("order_id"),
        F.col("customer").alias("customer_name"),
        "user_id",
        "user_name",
    )


def order_product_info(order_id: int, products: DataFrame) -> DataFrame:
    """The product list as answered for one order."""
    return products.select(F.lit(order_id).cast("bigint").alias("order_id"), *products.columns)


def numbered(table: DataFrame, by: str) -> DataFrame:
    """Add ``number`` = 1, 2, 3, ... in the order of the unique column ``by``.

    Rows are sorted into ranges of the key and numbered inside their range; one row per range, so no more
    than there are partitions, meets in one place to give the ranges their offsets. The sorted rows are
    stored, as another sampling of the ranges could cut them elsewhere.
    """
    ranges = staged(
        table.repartitionByRange(F.col(by)).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(W.partitionBy("_range").orderBy(by))
    return (
        ranges.withColumn("_inside", inside)
        .join(offsets, "_range")
        .withColumn("number", F.col("_offset") + F.col("_inside"))
        .drop("_range", "_inside", "_offset")
    )


def insert_rows(
    table: DataFrame,
    new_rows: DataFrame,
    order: str,
    required: Sequence[str],
    defaults: Mapping[str, object],
) -> tuple[DataFrame, DataFrame]:
    """``(table after the insert, refused rows)``.

    New ids continue after the highest one in the order of the unique integer column ``order``.
    Rows that lack a required field are refused; other missing fields take their default.
    """
    complete = F.lit(True)
    for name in required:
        complete = complete & F.col(name).isNotNull()
    refused = new_rows.filter(~complete)
    highest = table.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    values = {
        f.name: F.coalesce(F.col(f.name), F.lit(defaults.get(f.name)).cast(f.dataType))
        for f in table.schema
        if f.name != "id"
    }
    accepted = numbered(new_rows.filter(complete), order).select(
        (highest + F.col("number")).alias("id"),
        *[value.alias(name) for name, value in values.items()],
    )
    return table.unionByName(accepted.select(*table.columns)), refused


def update_rows(
    table: DataFrame,
    changes: DataFrame,
    renamed: Mapping[str, str] | None = None,
    order: str | None = None,
) -> DataFrame:
    """Given (non-null) fields of ``changes`` overwrite those of the row with the same ``id``.

    Of several changes of one field of a row the last by the column ``order`` counts (without that column the
    greatest value). Changes of ids that the table lacks change nothing, see :func:`unknown_changes`.

    ``renamed`` maps other field names in the changes to columns; columns the table does not have
    are left out. Serves full updates and patches alike: a DataFrame has a fixed set of columns.
    """
    new = changes.withColumnsRenamed(dict(renamed or {}))
    given = [c for c in table.columns if c != "id" and c in new.columns]
    # max_by skips rows whose rank is null, so fields that a change leaves out do not count
    new = new.groupBy("id").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order or c))).alias(f"_new_{c}")
            for c in given
        ]
    )
    return table.join(new, "id", "left").select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in given else F.col(c) for c in table.columns]
    )


def unknown_changes(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Ids of changes (answered with 404) that the table does not have."""
    return (
        changes.select("id").distinct().join(table.select("id"), "id", "left_anti")
        .select("id", F.lit(404).alias("status_code"))
    )


def delete_rows(table: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(remaining rows, deleted rows)``."""
    return table.join(ids, "id", "left_anti"), table.join(ids, "id", "left_semi")
