"""Quality profile of whole tables: nulls, types, duplicates, freshness, score.

``measure`` reads the table once.  Rows are first counted per distinct row, which
gives the duplicates; the null counts and load times are then taken from those
counted rows, so that no second scan is needed.  Both steps combine inside the
tasks before they shuffle, and a frequent group or row therefore costs no more
than a rare one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.config import QualityConfig
from tablepulse.functions.keys import row_keys
from tablepulse.functions.scores import clamp_score, quality_severity
from tablepulse.functions.times import hours_since, moment
from tablepulse.functions.types import TEXT, family_of, fits_family, looks_boolean, looks_numeric, parse_time
from tablepulse.operators.relational import data_columns

# A check maps the data columns to named aggregate expressions.
Check = Callable[[list[str]], list[Column]]

# Null flags per column are packed into whole numbers of this many bits.
MASK_BITS = 60


def _missing(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def _null_masks(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Which columns of a row are NULL (or NaN), one bit each."""
    masks = []
    for start in range(0, len(columns), MASK_BITS):
        bits = [
            F.when(_missing(df, c), F.lit(1 << i)).otherwise(0).cast("bigint")
            for i, c in enumerate(columns[start : start + MASK_BITS])
        ]
        masks.append(reduce(add, bits).alias(f"_mask_{start // MASK_BITS}"))
    return masks


def _rows_with_null(position: int) -> Column:
    mask = F.col(f"_mask_{position // MASK_BITS}")
    is_null = mask.bitwiseAND(F.lit(1 << position % MASK_BITS)) != 0
    return F.coalesce(F.sum(F.when(is_null, F.col("_n"))), F.lit(0))


def count_rows(df: DataFrame, columns: Sequence[str], group_by: Sequence[str] = (), loaded_at: str | None = None) -> DataFrame:
    """Distinct rows over ``columns`` per group with null flags, number and latest load time."""
    keys = [key.alias(f"_key_{i}") for i, key in enumerate(row_keys(df, columns))]
    measures = [F.count(F.lit(1)).alias("_n")]
    if loaded_at:
        ts = F.col(loaded_at)
        if isinstance(df.schema[loaded_at].dataType, T.StringType):
            ts = F.try_to_timestamp(ts)
        measures.append(F.max(ts).alias("_latest"))
    return df.groupBy(*group_by, *keys, *_null_masks(df, columns)).agg(*measures)


def duplicate_rows(df: DataFrame, group_by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that have an equal row, all members counted, and their share."""
    columns = list(columns or data_columns(df))
    counted = count_rows(df, [c for c in columns if c not in group_by], group_by)
    repeated = F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0))
    out = counted.groupBy(*group_by).agg(F.sum("_n").alias("total_rows"), repeated.alias("duplicate_count"))
    return out.withColumn("duplicate_rate", F.round(F.try_divide("duplicate_count", "total_rows"), 6))


def measure(
    df: DataFrame,
    group_by: Sequence[str] = (),
    types: Mapping[str, str] | None = None,
    strict_types: bool = False,
    loaded_at: str | None = None,
) -> DataFrame:
    """Per group: rows, duplicates, latest load time and an array with one entry per data column.

    ``types`` gives the registered logical type of each column.  Columns that are
    not registered pass the type test, or count as text with ``strict_types``.
    """
    columns = [c for c in data_columns(df) if c not in group_by]
    if not columns:
        raise ValueError("no data column to measure")
    if loaded_at is None:
        loaded_at = next((c for c in df.columns if c.lower() == "_silver_loaded_at"), None)
    counted = count_rows(df, columns, group_by, loaded_at)

    n = F.col("_n")
    totals = [
        F.sum(n).alias("total_rows"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("duplicate_count"),
        (F.max("_latest") if loaded_at else F.lit(None).cast("timestamp_ntz")).alias("latest_loaded_at"),
    ]
    totals += [_rows_with_null(i).alias(f"_nulls_{i}") for i in range(len(columns))]
    summed = counted.groupBy(*group_by).agg(*totals).filter(F.col("total_rows") > 0)

    registered = {name.lower(): kind for name, kind in (types or {}).items()}
    entries = []
    for i, c in enumerate(columns):
        kind = registered.get(c.lower(), TEXT if strict_types else None)
        fits = kind is None or fits_family(df.schema[c].dataType, family_of(kind))
        nulls = F.col(f"_nulls_{i}")
        type_ok = F.lit(fits) | (nulls == F.col("total_rows"))
        entries.append(
            F.struct(
                F.lit(c).alias("column_name"),
                nulls.alias("null_count"),
                F.round(nulls / F.col("total_rows"), 6).alias("null_rate"),
                type_ok.alias("type_ok"),
                F.when(type_ok, F.lit(0)).otherwise(nulls).cast("bigint").alias("unexpected_count"),
            )
        )
    return summed.select(
        *group_by, "total_rows", "duplicate_count", "latest_loaded_at", F.array(*entries).alias("columns")
    )


def column_metrics(measured: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """One row per data column."""
    return measured.select(*group_by, F.inline("columns"))


def metric_rows(columns: DataFrame, group_by: Sequence[str] = (), config: QualityConfig = QualityConfig()) -> DataFrame:
    """Column results as (column, metric type, value, threshold, passed)."""
    null_rate = F.struct(
        F.lit("null_rate").alias("metric_type"),
        F.col("null_rate").alias("metric_value"),
        F.lit(config.null_rate_threshold).alias("threshold"),
        (F.col("null_rate") <= config.null_rate_threshold).alias("passed"),
    )
    mismatch = F.struct(
        F.lit("type_mismatch").alias("metric_type"),
        F.when(F.col("type_ok"), 0.0).otherwise(1.0).alias("metric_value"),
        F.lit(config.type_mismatch_threshold).alias("threshold"),
        F.col("type_ok").alias("passed"),
    )
    return columns.select(*group_by, "column_name", F.inline(F.array(null_rate, mismatch)))


def _total(field: Callable[[Column], Column]) -> Column:
    """Sum of ``field`` over the per-column entries."""
    return F.aggregate("columns", F.lit(0.0), lambda acc, c: acc + field(c).cast("double"))


def freshness_score(hours: Column, config: QualityConfig = QualityConfig()) -> Column:
    """1 for fresh data, 0 from ``freshness_max_hours`` on; unknown age counts as fresh."""
    fresh = F.greatest(F.lit(0.0), 1 - hours / config.freshness_max_hours)
    return F.when(hours.isNull(), 1.0).otherwise(F.round(fresh, 6))


def quality_score(
    null_rate: Column,
    duplicate_rate: Column,
    mismatch_rate: Column,
    freshness: Column,
    range_rate: Column,
    config: QualityConfig = QualityConfig(),
) -> Column:
    """Weighted score between 0 and 100, two digits."""
    parts = [
        (1 - null_rate, config.weight_null),
        (1 - duplicate_rate, config.weight_duplicate),
        (1 - mismatch_rate, config.weight_type),
        (freshness, config.weight_freshness),
        (1 - range_rate, config.weight_range),
    ]
    total = sum((rate * weight * 100 for rate, weight in parts), F.lit(0.0))
    return F.round(clamp_score(total), 2)


def rates(measured: DataFrame, as_of: str | Column, group_by: Sequence[str] = ()) -> DataFrame:
    """Table-level rates and the tally of fulfilled expectations.

    Two expectations per column (no NULL, right type) and one on the table (no
    duplicates).  ``as_of`` may be a column of the measured rows.
    """
    at = as_of if isinstance(as_of, Column) else moment(as_of)
    size = F.size("columns")
    unexpected = _total(lambda c: c["unexpected_count"])
    fulfilled = _total(lambda c: (c["null_count"] == 0).cast("int") + c["type_ok"].cast("int"))
    return measured.select(
        *group_by,
        "total_rows",
        size.alias("total_columns"),
        F.round(_total(lambda c: c["null_rate"]) / size, 6).alias("null_rate"),
        "duplicate_count",
        F.round(F.col("duplicate_count") / F.col("total_rows"), 6).alias("duplicate_rate"),
        F.round(_total(lambda c: (~c["type_ok"]).cast("int")) / size, 6).alias("type_mismatch_rate"),
        F.round(F.least(unexpected / (size * F.col("total_rows")), F.lit(1.0)), 6).alias("range_fail_rate"),
        hours_since(F.col("latest_loaded_at"), at).alias("freshness_hours"),
        (fulfilled + (F.col("duplicate_count") == 0).cast("int")).cast("bigint").alias("expectations_passed"),
        (size * 2 + 1).cast("bigint").alias("expectations_total"),
    )


def score(rated: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Adds freshness score, quality score, verdict and severity."""
    return (
        rated.withColumn("freshness_score", freshness_score(F.col("freshness_hours"), config))
        .withColumn(
            "quality_score",
            quality_score(
                F.col("null_rate"),
                F.col("duplicate_rate"),
                F.col("type_mismatch_rate"),
                F.col("freshness_score"),
                F.col("range_fail_rate"),
                config,
            ),
        )
        .withColumn("passed", F.col("quality_score") >= config.min_score)
        .withColumn("severity", quality_severity(F.col("quality_score")))
    )


def profile(
    df: DataFrame,
    as_of: str,
    group_by: Sequence[str] = (),
    types: Mapping[str, str] | None = None,
    strict_types: bool = False,
    loaded_at: str | None = None,
    config: QualityConfig = QualityConfig(),
) -> DataFrame:
    """Measure, rate and score a table, or every group of it, in one scan."""
    return score(rates(measure(df, group_by, types, strict_types, loaded_at), as_of, group_by), config)


def run_checks(df: DataFrame, checks: Sequence[Check], group_by: Sequence[str] = ()) -> DataFrame:
    """All checks of the caller in one aggregation."""
    columns = [c for c in data_columns(df) if c not in group_by]
    return df.groupBy(*group_by).agg(*[e for check in checks for e in check(columns)])


def range_check(limits: Mapping[str, tuple[float | None, float | None]]) -> Check:
    """Counts, per column, the values outside ``(low, high)``; NULL is not counted."""
    def build(columns: list[str]) -> list[Column]:
        out = []
        for name, (low, high) in limits.items():
            if name in columns:
                outside = F.lit(False)
                if low is not None:
                    outside = outside | (F.col(name) < low)
                if high is not None:
                    outside = outside | (F.col(name) > high)
                out.append(F.count_if(outside).alias(f"{name}_out_of_range"))
        return out

    return build


def unparsable_check(types: Mapping[str, str]) -> Check:
    """Counts, per text column registered under another type, the values that do not convert."""
    readers = {
        "numeric": looks_numeric,
        "date": lambda text: parse_time(text).isNotNull(),
        "bool": looks_boolean,
    }

    def build(columns: list[str]) -> list[Column]:
        out = []
        for name, kind in types.items():
            reader = readers.get(family_of(kind))
            if reader is not None and name in columns:
                text = F.col(name).cast("string")
                out.append(F.count_if(text.isNotNull() & ~reader(text)).alias(f"{name}_unparsable"))
        return out

    return build
