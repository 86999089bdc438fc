"""Written intermediate tables.

Iterative and stateful steps cut their lineage with Parquet tables under the shared folder that
the cluster names in ``spark.checkpoint.dir``, so that they survive lost executors. Only a local
session without that setting gets a temporary folder.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="apilens-")


def staging_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_root()


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path for one written table; never used twice."""
    return f"{staging_root(spark)}/apilens/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and return the stored table."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
