"""Service attribution and the joins with service mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilens.functions.hosts import UNKNOWN, host_label, names_no_service
from apilens.functions.values import blank_to_null

# No join below carries a broadcast hint: pods, cluster services and mappings are small as a rule,
# but nothing bounds them. Spark broadcasts what its statistics (or the finished shuffle) show to be
# under spark.sql.autoBroadcastJoinThreshold, and otherwise joins by sort-merge, where adaptive
# execution splits the partitions of hot keys on the request side.


def address_directory(pods: DataFrame, k8s_services: DataFrame) -> DataFrame:
    """One name per address: pod label ``app``, pod label ``service``, cluster service name."""
    from_pods = pods.select(
        F.col("ip"),
        F.coalesce(
            blank_to_null(F.try_element_at("labels", F.lit("app"))),
            blank_to_null(F.try_element_at("labels", F.lit("service"))),
        ).alias("found"),
        F.lit(0).alias("rank"),
        "namespace",
        "name",
    )
    from_services = k8s_services.select(
        F.col("cluster_ip").alias("ip"),
        F.col("name").alias("found"),
        F.lit(1).alias("rank"),
        "namespace",
        "name",
    )
    return (
        from_pods.unionByName(from_services)
        .filter(F.col("found").isNotNull())
        .groupBy("ip")
        .agg(F.min_by("found", F.struct("rank", "namespace", "name", "found")).alias("ip_service"))
    )


def with_service(records: DataFrame, directory: DataFrame) -> DataFrame:
    """Add ``service``: first host label, or the address directory, or ``unknown``.

    For a response ``host`` is null until :func:`apilens.operators.messages.correlate`; the
    directory then names its destination, which is what an unpaired response keeps.
    """
    return (
        records.join(
            directory.withColumnRenamed("ip", "destination_ip"), "destination_ip", "left"
        )
        .withColumn(
            "service",
            F.when(
                names_no_service(F.col("host")), F.coalesce("ip_service", F.lit(UNKNOWN))
            ).otherwise(host_label(F.col("host"))),
        )
        .select(*[c for c in records.columns if c != "service"], "service")
    )


def last_mappings(mappings: DataFrame, order: str = "position") -> DataFrame:
    """One entry per service: the last by the column ``order`` where there is one, else the greatest."""
    ids = F.struct("appId", "instanceId")
    rank = F.struct(order, ids) if order in mappings.columns else ids
    return mappings.groupBy("service").agg(F.max_by(ids, rank).alias("last")).select(
        "service", "last.appId", "last.instanceId"
    )


def overlay_mappings(base: DataFrame, saved: DataFrame) -> DataFrame:
    """Base mappings with saved ones laid over; a saved entry replaces the whole base entry.

    Each side may name a service more than once, see :func:`last_mappings`.
    """
    old, new = last_mappings(base).alias("old"), last_mappings(saved).alias("new")
    taken = F.col("new.service").isNotNull()
    return old.join(new, F.col("old.service") == F.col("new.service"), "full").select(
        F.coalesce("new.service", "old.service").alias("service"),
        F.when(taken, F.col("new.appId")).otherwise(F.col("old.appId")).alias("appId"),
        F.when(taken, F.col("new.instanceId"))
        .otherwise(F.col("old.instanceId"))
        .alias("instanceId"),
        F.when(taken & F.col("old.service").isNull(), "added")
        .when(taken, "replaced")
        .otherwise("base")
        .alias("origin"),
    )


def merge_mappings(saved: DataFrame, new: DataFrame) -> DataFrame:
    """Saved mappings after storing ``new`` ones: the newest entry of a service wins."""
    return overlay_mappings(saved, new).drop("origin")


def usable_mappings(mappings: DataFrame) -> DataFrame:
    """Mappings with both ids present."""
    return mappings.select("service", "appId", "instanceId").filter(
        (F.col("appId") != "") & (F.col("instanceId") != "")
    )


def mapping_counts(overlaid: DataFrame) -> DataFrame:
    return overlaid.agg(
        F.count("*").alias("configured"),
        F.count_if(F.col("origin") == "added").alias("added"),
        F.count_if(F.col("origin") == "replaced").alias("replaced"),
        F.count_if((F.col("appId") != "") & (F.col("instanceId") != "")).alias("usable"),
    )


def catalog_candidates(records: DataFrame) -> DataFrame:
    """Requests of known services."""
    return records.filter((F.col("type") == "request") & (F.col("service") != UNKNOWN))


def map_services(requests: DataFrame, mappings: DataFrame) -> DataFrame:
    return requests.join(usable_mappings(mappings), "service")


def configured_services(services: DataFrame, mappings: DataFrame) -> DataFrame:
    return services.join(usable_mappings(mappings), "service", "left_semi")


def unmapped_services(requests: DataFrame, mappings: DataFrame) -> DataFrame:
    """Services without a usable mapping, with their request count and first record.

    Counted per service first, so the join sees one row per service.
    """
    seen = requests.groupBy("service").agg(
        F.count("*").alias("requests"), F.min_by("id", F.struct("ts", "id")).alias("first_id")
    )
    return seen.join(usable_mappings(mappings), "service", "left_anti")


def service_coverage(requests: DataFrame, mappings: DataFrame) -> DataFrame:
    """Requests per service seen, and whether the service is mapped."""
    seen = requests.groupBy("service").agg(F.count("*").alias("requests"))
    return seen.join(usable_mappings(mappings), "service", "left").select(
        "service",
        "requests",
        F.col("appId").isNotNull().alias("mapped"),
        F.col("appId").alias("app_id"),
        F.col("instanceId").alias("instance_id"),
    )
