"""Type names, promotion, fingerprints, diffs."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import types as T

from tablepulse.functions import types
from tablepulse.operators import schema


@pytest.mark.parametrize(
    "ddl,name",
    [
        ("tinyint", "NUMBER(5,0)"), ("smallint", "NUMBER(7,0)"), ("int", "NUMBER(10,0)"), ("bigint", "NUMBER(18,0)"),
        ("float", "FLOAT"), ("double", "FLOAT"), ("boolean", "BOOLEAN"), ("timestamp_ntz", "TIMESTAMP_NTZ"),
        ("timestamp", "TIMESTAMP_LTZ"), ("date", "DATE"), ("string", "VARCHAR(65535)"), ("array<int>", "VARCHAR(65535)"),
        ("decimal(10,2)", "NUMBER(10,2)"), ("interval day to second", "VARCHAR(100)"),
    ],
)
def test_logical_type(ddl, name):
    assert types.logical_type(T.StructType.fromDDL(f"x {ddl}")["x"].dataType) == name


@pytest.mark.parametrize(
    "ddl,family,fits",
    [
        ("int", "numeric", True), ("string", "numeric", False), ("double", "string", False), ("string", "string", True),
        ("boolean", "bool", True), ("int", "bool", True), ("string", "bool", True), ("double", "bool", False),
        ("timestamp", "date", True), ("string", "date", False), ("date", "unknown", True), ("boolean", "numeric", False),
    ],
)
def test_fits_family(ddl, family, fits):
    assert types.fits_family(T.StructType.fromDDL(f"x {ddl}")["x"].dataType, family) is fits


@pytest.mark.parametrize(
    "values,kind",
    [
        (["1", "2", None], "NUMBER(18,0)"),
        (["1.5", "2"], "FLOAT"),
        (["-1e3", "+.5"], "FLOAT"),
        (["1", "x"], schema.TEXT),
        (["1d", "2f"], schema.TEXT),
        (["2024-01-01", "2024-01-02 10:11:12"], "TIMESTAMP_NTZ"),
        (["01/31/2024", "2024/01/31"], "TIMESTAMP_NTZ"),
        (["2024-13-01"], schema.TEXT),
        (["99/99/2024"], schema.TEXT),
        (["true", "False", "YES"], "BOOLEAN"),
        (["1", "0"], "NUMBER(18,0)"),
        (["t", "maybe"], schema.TEXT),
        ([None, None], schema.TEXT),
        ([""], schema.TEXT),
    ],
)
def test_promotion(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    row = schema.infer_schema(df).first()
    assert row["logical_type"] == kind
    assert row["nullable"] is (None in values)


def test_nan_makes_a_column_nullable(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert schema.infer_schema(df).first()["nullable"]


def test_empty_table_has_no_schema(spark):
    assert schema.infer_schema(spark.createDataFrame([], "x int")).count() == 0
    with pytest.raises(schema.EmptyTableError):
        schema.infer_schema(spark.createDataFrame([], T.StructType([])))


def test_fingerprint_is_stable_and_order_free(spark):
    rows = [("name", "VARCHAR(65535)"), ('odd"name\\', "FLOAT"), ("id", "NUMBER(18,0)")]
    text = json.dumps(sorted(({"name": n, "type": t} for n, t in rows), key=lambda c: c["name"]), sort_keys=True)
    expected = hashlib.sha256(text.encode()).hexdigest()[:16]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "column_name string, logical_type string")
        assert schema.fingerprints(df).first()["fingerprint"] == expected


def changes(spark, old, new):
    kinds = "column_name string, logical_type string"
    found = schema.schema_changes(spark.createDataFrame(old, kinds), spark.createDataFrame(new, kinds))
    return {(r["change_type"], r["column_name"]): r["detail"] for r in found.collect()}


def test_changes(spark):
    same = [("a", "FLOAT"), ("b", "DATE")]
    assert changes(spark, same, same[::-1]) == {}
    got = changes(spark, [("a", "FLOAT"), ("b", "DATE"), ("c", "DATE")], [("a", "DATE"), ("b", "DATE"), ("d", "FLOAT")])
    assert got == {
        ("TYPE_CHANGE", "a"): "a was FLOAT and is DATE",
        ("DROP_COLUMN", "c"): "c is missing from now on, it was DATE",
        ("ADD_COLUMN", "d"): "d was added as FLOAT",
    }


def test_documents_read_back(spark):
    df = spark.createDataFrame([("1", "x", None), ("2", "y", 1.5)], "id string, s string, v double")
    inferred = schema.infer_schema(df)
    back = schema.explode_schema(schema.schema_documents(inferred))
    assert [tuple(r) for r in back.collect()] == [("id", "NUMBER(18,0)"), ("s", schema.TEXT), ("v", "FLOAT")]


def test_samples(spark):
    df = spark.createDataFrame([(i, None if i < 3 else i * 10, "c") for i in range(9)], "_k int, v int, s string")
    got = schema.sample_values(df, "_k").collect()
    assert [r["sample_value"] for r in got if r["column_name"] == "v"] == ["30", "40", "50", "60", "70"]
    assert len([r for r in got if r["column_name"] == "s"]) == 5
    assert [r["sample_value"] for r in schema.sample_values(df.limit(5), "_k").collect() if r["column_name"] == "v"] == ["30", "40"]
    plan = schema.sample_values(df, "_k")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_samples_equal_a_plain_ranking(spark):
    rows = [(i * 7919 % 1000, None if i % 3 else i, i % 2 and "x") for i in range(1000)]
    df = spark.createDataFrame([(k, v, s or None) for k, v, s in rows], "_k int, v int, s string").repartition(6)
    got = schema.sample_values(df, "_k", 7).collect()
    for position, name in ((1, "v"), (2, "s")):
        present = sorted((r[0], str(r[position])) for r in rows if r[position] not in (None, 0) or r[position] == 0 and name == "v")
        want = [value for _, value in present[:7]]
        assert [r["sample_value"] for r in sorted(got, key=lambda r: r["sample_no"]) if r["column_name"] == name] == want
