"""Continuous catalog maintenance: each micro-batch of requests is matched, decided and applied."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from apilens.operators.catalog import (
    INSTANCE,
    catalog_changes,
    endpoint_parameters,
    match_catalog,
    parameter_changes,
    plan_catalog_actions,
)
from apilens.operators.onboarding import onboarded_mappings, plan_onboarding
from apilens.operators.services import (
    catalog_candidates,
    map_services,
    merge_mappings,
    unmapped_services,
    usable_mappings,
)
from apilens.sources.changes import COMPACT_EVERY, START, ChangedTable
from apilens.staging import staged

_CATALOG = (*INSTANCE, "endpoint_id", "method", "path", "body_example")
_PARAMETERS = (
    "appId string, instanceId string, endpoint_id string, kind string, name string, value string, times_seen bigint"
)
_ONBOARDING = "service string, action string, application_id string, instance_id string, first_id string"


class CatalogTables:
    """What a catalog stream keeps under ``root``: the catalog, parameters of endpoints, mappings, onboardings."""

    def __init__(self, spark: SparkSession, root: str, compact_every: int = COMPACT_EVERY) -> None:
        def table(name: str, *keys: str) -> ChangedTable:
            return ChangedTable(spark, root, name, keys, compact_every)

        self.spark, self.root = spark, root
        self.catalog = table("catalog", *INSTANCE, "method", "path")
        self.parameters = table("parameters", *INSTANCE, "endpoint_id", "kind", "name")
        self.mappings = table("mappings", "service")
        self.onboarding = table("onboarding", "service")

    def start(self, catalog: DataFrame, mappings: DataFrame) -> None:
        """Write what the first micro-batch (number 0) starts from."""
        self.catalog.start(catalog.select(*_CATALOG))
        self.mappings.start(mappings.select("service", "appId", "instanceId"))
        self.parameters.start(self.spark.createDataFrame([], _PARAMETERS))
        self.onboarding.start(self.spark.createDataFrame([], _ONBOARDING))
        self.note(START)

    def note(self, version: int) -> None:
        """A version counts once this is written, after all its files."""
        self.spark.range(1).select(F.lit(version).alias("number")).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/versions/version={version}"
        )

    def last(self) -> int:
        """The newest version that was written whole; -1 is what the stream started from."""
        return int(self.spark.read.parquet(f"{self.root}/versions").agg(F.max("number")).first()[0])


def start_versions(catalog: DataFrame, mappings: DataFrame, root: str) -> None:
    CatalogTables(catalog.sparkSession, root).start(catalog, mappings)


def apply_batch(
    root: str,
    applications: Callable[[], DataFrame],
    auto_onboard: bool,
    saved_mappings: Callable[[int], DataFrame] | None = None,
    compact_every: int = COMPACT_EVERY,
) -> Callable[[DataFrame, int], None]:
    """Micro-batch function: version ``n - 1`` of the tables and the batch give version ``n``.

    All of them are read anew for every batch, as are ``saved_mappings`` (given the number of the batch), whose
    usable entries go before the stored ones. Only rows that change are written, and a repeated batch overwrites its own
    version, so a restart neither loses nor doubles a change. Services are onboarded before their requests are
    mapped, so no request waits for a later batch, and only once: what was planned for a service is stored and not
    planned again, also where the application must be created first.
    """

    def run(batch: DataFrame, number: int) -> None:
        tables = CatalogTables(batch.sparkSession, root, compact_every)
        before = number - 1
        mappings = tables.mappings.read(before)
        if saved_mappings is not None:
            mappings = merge_mappings(mappings, usable_mappings(saved_mappings(number)))
        mappings = staged(mappings, "mappings")
        requests = staged(catalog_candidates(batch), "requests")
        if auto_onboard:
            open_services = unmapped_services(requests, mappings).join(
                tables.onboarding.read(before), "service", "left_anti"
            )
            plan = plan_onboarding(open_services, applications(), auto_onboard)
            planned = plan.join(open_services.select("service", "first_id"), "service")
            tables.onboarding.write(planned.select("service", "action", "application_id", "instance_id", "first_id"), number)
        else:
            tables.onboarding.write(tables.onboarding.read(before).limit(0), number)
        onboarded = onboarded_mappings(tables.onboarding.change(number, _ONBOARDING))
        tables.mappings.write(onboarded, number)
        current = merge_mappings(mappings, onboarded)
        catalog = tables.catalog.read(before)
        actions = staged(plan_catalog_actions(match_catalog(map_services(requests, current), catalog)), "actions")
        tables.catalog.write(catalog_changes(catalog, actions).select(*_CATALOG), number)
        tables.parameters.write(
            parameter_changes(tables.parameters.read(before), endpoint_parameters(actions)), number
        )
        tables.note(number)

    return run


def maintain_catalog(
    records: DataFrame,
    root: str,
    checkpoint: str,
    applications: Callable[[], DataFrame],
    auto_onboard: bool = False,
    saved_mappings: Callable[[int], DataFrame] | None = None,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    run = apply_batch(root, applications, auto_onboard, saved_mappings, compact_every)
    return (
        records.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_requests(records: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first record of each service within the watermark delay, to start an onboarding."""
    return (
        records.filter(F.col("type") == "request")
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["service"])
    )
