"""The endpoint inventory: which endpoints each service exposes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilens.functions.paths import norm_path, path_template


def endpoint_inventory(requests: DataFrame) -> DataFrame:
    """Per service, method and path template: hits, distinct raw paths, first and last seen.

    Counted per raw path first. That level combines before its shuffle, so a hot endpoint is
    already small there, and the second level only adds up one row per raw path.
    """
    per_path = requests.groupBy("service", "method", "endpoint").agg(
        F.count("*").alias("hits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    return per_path.groupBy(
        "service", "method", path_template(norm_path(F.col("endpoint"))).alias("template")
    ).agg(
        F.sum("hits").alias("hits"),
        F.count("*").alias("raw_paths"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
