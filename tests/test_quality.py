"""Quality against pandas, edge cases."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablepulse.functions import keys
from tablepulse.operators import quality

SCHEMA = "k int, v double, s string, _audit string"
LONG = "z" * 3000
ROWS = [
    (1, 1.0, "a", "p"), (1, 1.0, "a", "q"), (1, 1.0, "a", "r"),
    (2, None, None, "p"), (2, None, None, "q"),
    (3, float("nan"), "b", "p"), (4, 4.0, LONG + "1", "p"), (4, 4.0, LONG + "2", "p"),
    (5, 5.0, LONG, "p"), (5, 5.0, LONG, "p"),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def test_profile_equals_pandas(table):
    frame = pd.DataFrame(ROWS, columns=["k", "v", "s", "_audit"])
    data = frame[["k", "v", "s"]]
    row = quality.profile(table, "2024-01-01").first()
    assert row["total_rows"] == len(frame)
    assert row["duplicate_count"] == int(data.duplicated(keep=False).sum())
    rates = [round(float(data[c].isna().mean()), 6) for c in data]
    assert row["null_rate"] == pytest.approx(round(sum(rates) / 3, 6), abs=1e-6)
    nulls = {r["column_name"]: r["null_count"] for r in quality.column_metrics(quality.measure(table)).collect()}
    assert nulls == {c: int(data[c].isna().sum()) for c in data}
    expected = (1 - row["null_rate"]) * 30 + (1 - row["duplicate_rate"]) * 20 + 25 + 15 + 10
    assert row["quality_score"] == pytest.approx(expected, abs=0.006)


def test_long_texts_are_compared_whole(table):
    assert quality.duplicate_rows(table).first()["duplicate_count"] == 7


def test_expectations_and_freshness_default(table):
    row = quality.profile(table, "2024-01-01").first()
    # k has no NULL, all three types pass, there are duplicates.
    assert (row["expectations_passed"], row["expectations_total"]) == (4, 7)
    assert row["freshness_hours"] is None and row["freshness_score"] == 1.0


def test_freshness_reads_text_times_and_ignores_bad_ones(spark):
    rows = [(1, "2024-01-01 00:00:00"), (2, "never"), (3, "2023-12-31 00:00:00")]
    df = spark.createDataFrame(rows, "k int, _SILVER_LOADED_AT string")
    row = quality.profile(df, "2024-01-01 06:00:00").first()
    assert row["freshness_hours"] == 6.0
    assert row["freshness_score"] == 0.75


def test_empty_table_gives_no_row(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.profile(empty, "2024-01-01").count() == 0
    assert quality.profile(empty, "2024-01-01", ["k"]).count() == 0


def test_single_row(spark):
    row = quality.profile(spark.createDataFrame([(1, 2.0, "x", "p")], SCHEMA), "2024-01-01").first()
    assert (row["quality_score"], row["passed"], row["severity"]) == (100.0, True, "info")


def test_type_mismatch_counts_nulls_as_unexpected(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "c")], "k int, s string")
    metrics = {r["column_name"]: r for r in quality.column_metrics(quality.measure(df, types={"K": "VARCHAR", "S": "NUMBER"})).collect()}
    assert not metrics["k"]["type_ok"] and metrics["k"]["unexpected_count"] == 0
    assert not metrics["s"]["type_ok"] and metrics["s"]["unexpected_count"] == 1
    row = quality.profile(df, "2024-01-01", types={"K": "VARCHAR", "S": "NUMBER"}).first()
    assert row["type_mismatch_rate"] == 1.0
    assert row["range_fail_rate"] == 0.125


def test_all_null_column_has_the_right_type(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k int, s string")
    metrics = {r["column_name"]: r["type_ok"] for r in quality.column_metrics(quality.measure(df, types={"s": "FLOAT"})).collect()}
    assert metrics["s"]


def test_nested_columns_are_compared_by_value(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2],), ([1],), (None,)], "a array<int>")
    row = quality.duplicate_rows(df).first()
    assert (row["total_rows"], row["duplicate_count"]) == (4, 2)


def test_grouped_profile_equals_profile_of_each_group(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    grouped = {r["event_type"]: r["quality_score"] for r in quality.profile(events, "2024-01-31", ["event_type"], loaded_at="ts").collect()}
    for kind, score in grouped.items():
        one = events.filter(F.col("event_type") == kind).drop("event_type")
        assert quality.profile(one, "2024-01-31", loaded_at="ts").first()["quality_score"] == score


def test_column_named_with_a_dot(spark):
    df = spark.createDataFrame([(1,), (None,)], "`a.b` int")
    assert quality.column_metrics(quality.measure(df)).first()["null_count"] == 1


@pytest.mark.parametrize("key_bytes", [0, 10_000])
def test_rows_are_compared_by_digest_or_directly(spark, monkeypatch, key_bytes):
    monkeypatch.setattr(keys, "KEY_BYTES", key_bytes)
    wide = "a double, t timestamp_ntz, s string, u string, x binary, y array<int>, z decimal(10,2), d date"
    from datetime import date, datetime
    from decimal import Decimal

    def row(a=1.0, micro=5, s="a", u="bc", x=b"q", y=(1,), z="1.50"):
        return (a, datetime(2024, 1, 1, 0, 0, 0, micro), s, u, x, list(y), Decimal(z), date(2024, 1, 1))

    rows = [row(), row(), row(a=0.0), row(a=-0.0), row(micro=6), row(s="ab", u="c"), row(s=None), row(s="-"), row(a=float("nan")), row(a=float("nan")), row(u=None, s=None)]
    df = spark.createDataFrame(rows, wide).repartition(3)
    row = quality.duplicate_rows(df).first()
    assert (row["total_rows"], row["duplicate_count"]) == (11, 6)
    nulls = {r["column_name"]: r["null_count"] for r in quality.column_metrics(quality.measure(df)).collect()}
    assert nulls == {"a": 2, "t": 0, "s": 2, "u": 1, "x": 0, "y": 0, "z": 0, "d": 0}


def test_more_columns_than_one_mask_holds(spark):
    df = spark.range(4).select(*[F.when(F.col("id") >= i % 4, F.col("id")).alias(f"c{i}") for i in range(130)])
    nulls = {r["column_name"]: r["null_count"] for r in quality.column_metrics(quality.measure(df)).collect()}
    assert all(nulls[f"c{i}"] == i % 4 for i in range(130))


@pytest.mark.parametrize("wide", [False, True])
def test_lost_hour_and_nested_times_are_no_duplicates(spark, wide):
    """Times without zone of the hour that daylight saving skips, and structs a microsecond apart."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        extra = ", ".join(f"'x' AS c{i}" for i in range(12 if wide else 1))
        df = spark.sql(f"""
            SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00' AS t, {extra} UNION ALL SELECT TIMESTAMP_NTZ'2024-03-10 03:30:00', {extra}""")
        assert quality.duplicate_rows(df).first()["duplicate_count"] == 0
        nested = spark.sql(f"""
            SELECT struct(TIMESTAMP_NTZ'2024-01-01 00:00:00.000001') AS s, {extra}
            UNION ALL SELECT struct(TIMESTAMP_NTZ'2024-01-01 00:00:00.000002'), {extra}""")
        assert quality.duplicate_rows(nested).first()["duplicate_count"] == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
