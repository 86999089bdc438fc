"""Configuration, catalog and application documents as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apilens import schemas


def parse_documents(documents: DataFrame, schema: str) -> DataFrame:
    """JSON texts (``value``) to rows; text that is not JSON gives a row of nulls."""
    parsed = F.from_json("value", schema)
    others = [c for c in documents.columns if c != "value"]
    return documents.select(*others, parsed.alias("d")).select(*others, "d.*")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file."""
    return parse_documents(spark.read.text(path, wholetext=True), schema)


def service_config(documents: DataFrame) -> DataFrame:
    """Settings with their defaults; a document that does not parse is all defaults."""
    return documents.select(
        F.nullif(F.trim("apiKey"), F.lit("")).isNotNull().alias("has_api_key"),
        F.coalesce("autoOnboardNewServices", F.lit(False)).alias("auto_onboard"),
        F.coalesce(
            "serviceMappings",
            F.create_map().cast("map<string, struct<appId:string, instanceId:string>>"),
        ).alias("service_mappings"),
    )


def mappings_of(config: DataFrame) -> DataFrame:
    return config.select(F.explode("service_mappings").alias("service", "ids")).select(
        "service", "ids.appId", "ids.instanceId"
    )


def read_service_mappings(spark: SparkSession, path: str) -> DataFrame:
    return mappings_of(service_config(read_documents(spark, path, schemas.SERVICE_CONFIG)))


def parse_catalog_listings(documents: DataFrame) -> DataFrame:
    """``appId, instanceId, document`` (JSON text) to ``appId, instanceId, endpointGroups``."""
    listing = F.from_json("document", schemas.CATALOG_LISTING)
    return documents.select("appId", "instanceId", listing["endpointGroups"].alias("endpointGroups"))


def parse_application_listings(documents: DataFrame) -> DataFrame:
    """``listing, document`` (JSON text) to ``listing, applications``."""
    parsed = F.from_json("document", schemas.APPLICATION_LISTING)
    return documents.select("listing", parsed["applications"].alias("applications"))


def mappings_document(mappings: DataFrame) -> DataFrame:
    """Mappings as stored: one JSON record per service, written in parallel."""
    return mappings.select(
        F.to_json(F.struct("service", "appId", "instanceId")).alias("value")
    )


def write_mappings(mappings: DataFrame, path: str) -> None:
    """Write to a new path; the reader is switched to it afterwards."""
    mappings.write.mode("errorifexists").json(path)


def read_saved_mappings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SERVICE_MAPPINGS).json(path).filter(
        F.col("service").isNotNull()
    )
