"""Plan for services without a mapping: reuse an application, or what has to be created."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REUSE, CREATE_INSTANCE, CREATE_APP = "REUSE", "CREATE_INSTANCE", "CREATE_APP"


def flatten_applications(listings: DataFrame) -> DataFrame:
    """Application listing documents to application x instance rows; no instance gives a null.

    ``listing`` (a bigint column) orders several documents.
    """
    apps = listings.select("listing", F.posexplode("applications").alias("app_pos", "app"))
    return apps.select(
        "listing",
        "app_pos",
        F.col("app.applicationId").alias("application_id"),
        F.col("app.applicationName").alias("application_name"),
        F.posexplode_outer("app.instances").alias("instance_pos", "instance"),
    ).select(
        "listing",
        "app_pos",
        "application_id",
        "application_name",
        "instance_pos",
        F.col("instance.instanceId").alias("instance_id"),
        F.col("instance.instanceName").alias("instance_name"),
    )


def first_application(flat: DataFrame) -> DataFrame:
    """First application of each name with its first instance, by position in the listing."""
    return (
        flat.groupBy("application_name")
        .agg(
            F.min_by(
                F.struct("application_id", "instance_id"),
                F.struct("listing", "app_pos", F.coalesce("instance_pos", F.lit(0))),
            ).alias("first")
        )
        .select("application_name", "first.application_id", "first.instance_id")
    )


def plan_onboarding(
    unmapped: DataFrame, flat_applications: DataFrame, auto_onboard: bool = False
) -> DataFrame:
    """One row per unmapped service; empty unless onboarding is switched on.

    Names are compared exactly, case included.
    """
    services = unmapped.select("service").distinct().filter(F.lit(auto_onboard))
    return services.join(
        first_application(flat_applications).withColumnRenamed("application_name", "service"),
        "service",
        "left",
    ).select(
        "service",
        F.when(F.col("application_id").isNull(), CREATE_APP)
        .when(F.col("instance_id").isNull(), CREATE_INSTANCE)
        .otherwise(REUSE)
        .alias("action"),
        "application_id",
        "instance_id",
    )


def onboarded_mappings(plan: DataFrame) -> DataFrame:
    """Mappings that can be stored at once: the services that reuse an instance."""
    return plan.filter(F.col("action") == REUSE).select(
        "service",
        F.col("application_id").alias("appId"),
        F.col("instance_id").alias("instanceId"),
    )


def instance_request_json(plan: DataFrame) -> DataFrame:
    """``{instanceRequestItems:[{hostUrl, instanceName}]}`` where an instance has to be created."""
    item = F.struct(
        F.lit("/").alias("hostUrl"),
        F.concat("service", F.lit("_instance")).alias("instanceName"),
    )
    return plan.filter(F.col("action") != REUSE).select(
        "service",
        F.to_json(F.struct(F.array(item).alias("instanceRequestItems"))).alias("document"),
    )


def empty_spec_json(plan: DataFrame) -> DataFrame:
    """Minimal OpenAPI document for every application that has to be created."""
    info = F.struct(
        F.col("service").alias("title"),
        F.lit("1.0.0").alias("version"),
        F.concat(F.lit("Auto-onboarded service: "), F.col("service")).alias("description"),
    )
    server = F.struct(F.lit("/").alias("url"), F.lit("Default server").alias("description"))
    document = F.struct(
        F.lit("3.0.0").alias("openapi"),
        info.alias("info"),
        F.array(server).alias("servers"),
        F.create_map().cast("map<string,string>").alias("paths"),
    )
    return plan.filter(F.col("action") == CREATE_APP).select(
        "service", F.to_json(document).alias("document")
    )
