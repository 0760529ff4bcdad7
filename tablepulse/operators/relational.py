"""Projections, filters, joins, grouped counts and top-n used by the reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def data_columns(df: DataFrame) -> list[str]:
    """Names without the audit columns, which start with an underscore."""
    return [c for c in df.columns if not c.startswith("_")]


def select_data(df: DataFrame) -> DataFrame:
    return df.select(*data_columns(df))


def common_columns(current: DataFrame, reference: DataFrame) -> list[str]:
    known = set(reference.columns)
    return [c for c in data_columns(current) if c in known]


def equals_if_given(df: DataFrame, value: str | None, column: Column | str) -> DataFrame:
    """Filter on equality, or ``df`` itself when no value was given."""
    if value is None:
        return df
    column = F.col(column) if isinstance(column, str) else column
    return df.filter(column == F.lit(value))


def dataset_filter(df: DataFrame, dataset: str | None) -> DataFrame:
    return equals_if_given(df, dataset, F.coalesce("silver_table", "dataset_id"))


def accepted_rows(df: DataFrame, run_id: str | None = None) -> DataFrame:
    """Rows that are not in quarantine, optionally of one run."""
    return equals_if_given(df.filter(~F.col("_is_quarantined")), run_id, "_pipeline_run_id")


def has_status(column: str, *wanted: str) -> Column:
    return F.lower(F.col(column)).isin(*wanted)


def newest(df: DataFrame, n: int, ts: str, *ties: str) -> DataFrame:
    """The ``n`` newest rows; rows without a time come last and ties go by ``ties``."""
    return df.orderBy(F.desc_nulls_last(ts), *ties).limit(n)


def keep_matching_top(df: DataFrame, key: str, top: DataFrame, top_key: str) -> DataFrame:
    """Semi-join with a top-n result."""
    return df.join(top.select(F.col(top_key).alias(key)), key, "left_semi")


def rows_of_latest(df: DataFrame, key: str, parents: DataFrame, parent_key: str, ts: str) -> DataFrame:
    """Rows that belong to the newest parent row."""
    return keep_matching_top(df, key, newest(parents, 1, ts, parent_key), parent_key)


def rows_not_in(source: DataFrame, target: DataFrame, keys: list[str], few: bool = False) -> DataFrame:
    """Source rows without a row of equal keys in the target; NULL equals NULL.

    The target grows with its history and its keys shuffle well compressed, so it is only broadcast if it is
    known to hold ``few`` keys.
    """
    known = target.select(*keys).distinct()
    known = known if few else known.hint("merge")
    match = reduce(lambda a, b: a & b, [source[k].eqNullSafe(known[k]) for k in keys])
    return source.join(known, match, "left_anti")


def distinct_values(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Sorted distinct non-NULL values."""
    return df.select(value.alias(name)).filter(F.col(name).isNotNull()).distinct().orderBy(name)


def daily_stats(df: DataFrame, ts: str, value: Column, **more: Column) -> DataFrame:
    """Mean, smallest and largest value per day, oldest day first, plus further aggregates."""
    return (
        df.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day"))
        .agg(
            F.avg(value).alias("avg_value"),
            F.min(value).alias("min_value"),
            F.max(value).alias("max_value"),
            *[column.alias(name) for name, column in more.items()],
        )
        .orderBy("day")
    )


def pass_fail_counts(df: DataFrame, key: str, passed: str = "passed") -> DataFrame:
    """Value counts of a flag per key, one column per outcome."""
    return (
        df.groupBy(key)
        .pivot(passed, [True, False])
        .count()
        .select(
            key,
            F.coalesce(F.col("true"), F.lit(0)).alias("passed_count"),
            F.coalesce(F.col("false"), F.lit(0)).alias("failed_count"),
        )
    )
