"""Quality metrics per event-time window, kept up to date while data arrives.

:func:`window_metrics` keeps open windows in the state store and leaves out rows that come
after their window closed.  :func:`start_counted_windows` keeps no state: each batch is summed
by window and written once, batches are added up when read, and late rows and rows without a
time are counted apart, so that the totals are those of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def window_metrics(
    events: DataFrame, ts: str, columns: Sequence[str], width: str = "15 minutes", late: str = "1 hour", group_by: Sequence[str] = ()
) -> DataFrame:
    """Rows, NULLs per column and latest time per window (and group), without rows later than ``late``."""
    slot = F.window(F.col("_event_time"), width)
    measures: list[Column] = [F.count(F.lit(1)).alias("total_rows"), F.max("_event_time").alias("latest_event")]
    measures += [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns]
    return (
        events.withColumn("_event_time", F.col(ts).cast("timestamp"))
        .withWatermark("_event_time", late)
        .groupBy(slot.alias("_slot"), *group_by)
        .agg(*measures)
        .select(
            F.col("_slot.start").alias("window_start"),
            F.col("_slot.end").alias("window_end"),
            *group_by,
            "total_rows",
            "latest_event",
            *[f"{c}_nulls" for c in columns],
        )
    )


def start_window_metrics(metrics: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the windows that changed in each batch to a folder of that batch.

    A replayed batch overwrites its own folder, so each update counts once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        metrics.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_window_metrics(spark: SparkSession, path: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Latest state of each window; the newest batch that touched it wins."""
    updates = spark.read.parquet(path)
    keys = ["window_start", *group_by]
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("row")).select(*keys, "row.*")


# What a row was when it came.
ON_TIME, LATE, UNDATED = "on_time", "late", "undated"


def _batch_folder(path: str, part: str, batch_id: int) -> str:
    return f"{path}/{part}/batch_id={batch_id}"


def _newest_before(spark: SparkSession, path: str, batch_id: int) -> datetime | None:
    """Newest event time of all batches before this one, which the last of them noted."""
    if batch_id == 0:
        return None
    return spark.read.parquet(_batch_folder(path, "newest", batch_id - 1)).first()["newest"]


def _placed(batch: DataFrame, ts: str, width: str, late: str, newest: datetime | None) -> DataFrame:
    """Adds window and arrival; a row is late if its window ended ``late`` before the newest earlier event."""
    time = F.col(ts).cast("timestamp_ntz")
    # Windows are not defined for NULL; such rows lose the stand-in below.
    rows = batch.withColumn("_event_time", time).withColumn(
        "_slot", F.window(F.coalesce("_event_time", F.lit("1970-01-01").cast("timestamp_ntz")), width)
    )
    dated = F.col("_event_time").isNotNull()
    closed = F.lit(False)
    if newest is not None:
        closed = F.col("_slot.end") <= F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {late}")
    return rows.withColumns(
        {
            "arrival": F.when(~dated, UNDATED).when(closed, LATE).otherwise(ON_TIME),
            "window_start": F.when(dated, F.col("_slot.start")),
            "window_end": F.when(dated, F.col("_slot.end")),
        }
    ).drop("_slot")


def start_counted_windows(
    events: DataFrame,
    ts: str,
    columns: Sequence[str],
    path: str,
    checkpoint: str,
    width: str = "15 minutes",
    late: str = "1 hour",
    group_by: Sequence[str] = (),
    keep_late: bool = False,
) -> StreamingQuery:
    """Sum each batch by window, group and arrival into ``path``; :func:`read_counted_windows` adds them up.

    Whether a row is late follows from the newest time of the batches before, so it does not depend on
    how a batch is split, and a replayed batch overwrites its own folders with equal rows.  A batch is
    read once; with ``keep_late`` once more, to store rows that were not on time below ``path/rows``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = _newest_before(spark, path, batch_id)
        rows = _placed(batch, ts, width, late, newest)
        measures = [F.count(F.lit(1)).alias("total_rows"), F.max("_event_time").alias("latest_event")]
        measures += [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns]
        summed = _batch_folder(path, "sums", batch_id)
        rows.groupBy("window_start", "window_end", "arrival", *group_by).agg(*measures).write.mode("overwrite").parquet(summed)
        if keep_late:
            kept = rows.filter(F.col("arrival") != ON_TIME).select(*batch.columns, "arrival")
            kept.write.mode("overwrite").parquet(_batch_folder(path, "rows", batch_id))
        latest = spark.read.parquet(summed).agg(F.max("latest_event").alias("latest"))
        known = F.lit(newest).cast("timestamp_ntz")
        latest.select(F.greatest("latest", known).alias("newest")).write.mode("overwrite").parquet(_batch_folder(path, "newest", batch_id))

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counted_windows(spark: SparkSession, path: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Metrics per window, group and arrival over all batches."""
    sums = spark.read.parquet(f"{path}/sums")
    keys = ["window_start", "window_end", "arrival", *group_by]
    counts = [c for c in sums.columns if c not in (*keys, "latest_event", "batch_id")]
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts], F.max("latest_event").alias("latest_event"))
