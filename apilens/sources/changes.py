"""Keyed tables that change with every micro-batch: a base, change files, merge on read.

``<root>/<table>/base=<n>`` holds the whole table as of version n, ``<root>/<table>/change=<n>`` the rows that
version n changed. A version is its newest base with the changes behind it laid over, the newest row of a key first. Every
``COMPACT_EVERY`` versions a new base is written. Which base belongs to a version follows from its number, so a repeated
micro-batch overwrites its own files and nothing else, and what it writes follows the batch, not the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A new base is written with every so many versions.
COMPACT_EVERY = 16
#: The version that a table starts from.
START = -1


class ChangedTable:
    """One table under ``root`` whose rows are known by ``keys``."""

    def __init__(self, spark: SparkSession, root: str, name: str, keys: Sequence[str], compact_every: int = COMPACT_EVERY):
        if compact_every < 1:
            raise ValueError("a base is written after one version at least")
        self.spark, self.path, self.keys, self.compact_every = spark, f"{root}/{name}", list(keys), compact_every

    def base_of(self, version: int) -> int:
        """The version whose base ``version`` is read from."""
        return (version + 1) // self.compact_every * self.compact_every + START

    def start(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self._base(START))

    def _base(self, version: int) -> str:
        return f"{self.path}/base={version}"

    def _change(self, version: int) -> str:
        return f"{self.path}/change={version}"

    def read(self, version: int) -> DataFrame:
        """The table as of a version. The base is not shuffled: only keys of changes meet it."""
        base = self.base_of(version)
        rows = self.spark.read.parquet(self._base(base))
        return self._over(rows, range(base + 1, version + 1))

    def _over(self, rows: DataFrame, versions: range) -> DataFrame:
        if not versions:
            return rows
        changes = None
        for number in versions:
            one = self.spark.read.schema(rows.schema).parquet(self._change(number)).withColumn("_version", F.lit(number))
            changes = one if changes is None else changes.unionByName(one)
        newest = (
            changes.groupBy(*self.keys)
            .agg(F.max_by(F.struct(*rows.columns), "_version").alias("row"))
            .select("row.*")
        )
        kept = rows.alias("old").join(
            newest.select(*self.keys).alias("new"),
            [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in self.keys],
            "left_anti",
        )
        return kept.unionByName(newest)

    def change(self, version: int, schema: str | None = None) -> DataFrame:
        """What a version changed."""
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self._change(version))

    def write(self, changed: DataFrame, version: int) -> None:
        """Store what ``version`` changes, and a new base if it is due."""
        changed.write.mode("overwrite").parquet(self._change(version))
        if self.base_of(version) == version:
            rows = self.spark.read.parquet(self._base(self.base_of(version - 1)))
            merged = self._over(rows, range(self.base_of(version - 1) + 1, version + 1))
            merged.write.mode("overwrite").parquet(self._base(version))
