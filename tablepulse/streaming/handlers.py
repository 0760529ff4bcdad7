"""Batch handlers that run the monitoring jobs for the events of a micro-batch.

Events are grouped by the table that they name: each table is profiled or compared
once for all of its events, whose facts are made and written as DataFrames.  Of the
events only the distinct table names reach the driver.  Failures are decided as one
DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tablepulse.config import CostConfig, DriftConfig, HealConfig, QualityConfig
from tablepulse.plans import jobs
from tablepulse.sources.facts import FactStore
from tablepulse.streaming.events import Handler, job_context

# Table name to rows, None for a table that does not exist.
Loader = Callable[[str], DataFrame | None]
# Current and reference table name to a frame with both windows.
Windows = Callable[[str, str], DataFrame | None]


def _contexts(store: FactStore, batch: DataFrame, at: str) -> DataFrame:
    """Job parameters of each event; ``at`` is the time it was published, else the given one."""
    published = F.try_to_timestamp("published_at")
    stamp = F.coalesce(F.date_format(published, "yyyy-MM-dd HH:mm:ss"), F.lit(at))
    request = F.coalesce("event_id", F.sha2(F.to_json(F.struct(*batch.columns)), 256))
    named = job_context(batch.withColumn("event_id", request), jobs.datasets(store))
    return named.withColumns({"at": stamp, "detected_at": published.cast("timestamp_ntz")})


def _requests(store: FactStore, batch: DataFrame, at: str) -> DataFrame:
    """Events of a batch that name a table."""
    named = _contexts(store, batch, at).filter(F.col("silver_table").isNotNull())
    text = {c: F.coalesce(c, F.lit("")) for c in ("dataset_id", "pipeline_run_id")}
    fields = ["event_id", "at", *text, "silver_table", "reference_table", "schema_version"]
    return named.withColumns(text).select(*fields).dropDuplicates(["event_id"])


def _of_tables(requests: DataFrame, *names: str) -> Iterator[tuple[Row, DataFrame]]:
    """The requests of each group of equal ``names``, one row of which reaches the driver."""
    requests = requests.persist()
    try:
        for key in requests.select(*names).distinct().collect():
            yield key, requests.filter(reduce(and_, [F.col(n).eqNullSafe(F.lit(key[n])) for n in names]))
    finally:
        requests.unpersist()


def quality_handler(store: FactStore, load: Loader, at: str, config: QualityConfig = QualityConfig()) -> Handler:
    def handle(batch: DataFrame, batch_id: int) -> None:
        for key, asked in _of_tables(_requests(store, batch, at), "dataset_id", "silver_table"):
            jobs.quality_jobs(store, load(key.silver_table), asked, key.dataset_id, key.silver_table, config)

    return handle


def drift_handler(
    store: FactStore, windows: Windows, at: str, config: DriftConfig = DriftConfig(), ts: str | None = None
) -> Handler:
    def handle(batch: DataFrame, batch_id: int) -> None:
        for key, asked in _of_tables(_requests(store, batch, at), "dataset_id", "silver_table", "reference_table"):
            sides = windows(key.silver_table, key.reference_table)
            jobs.drift_jobs(store, sides, asked, key.dataset_id, key.silver_table, key.reference_table, config, ts)

    return handle


def cost_handler(
    store: FactStore, usage: DataFrame, runs: DataFrame, at: str, config: CostConfig = CostConfig()
) -> Handler:
    def handle(batch: DataFrame, batch_id: int) -> None:
        fields = ["event_id", "at", "dataset_id", "pipeline_run_id", "warehouse_name", "lookback_days"]
        for c in _contexts(store, batch, at).select(*fields).dropDuplicates(["event_id"]).collect():
            jobs.cost_job(
                store, usage, runs, c.dataset_id or "", c.pipeline_run_id or "", c.at, c.lookback_days, c.warehouse_name, config,
                request=c.event_id,
            )

    return handle


def heal_handler(store: FactStore, at: str, config: HealConfig = HealConfig()) -> Handler:
    def handle(batch: DataFrame, batch_id: int) -> None:
        fields = ["event_id", "dataset_id", "pipeline_run_id", "failure_reason", "failed_task", "retry_count", "detected_at"]
        jobs.heal_job(store, _contexts(store, batch, at).select(*fields).dropDuplicates(["event_id"]), at, config)

    return handle
