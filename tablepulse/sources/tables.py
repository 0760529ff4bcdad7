"""Scans of tables that may be missing, and ordered lists of alternatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def scan(spark: SparkSession, table: str, fraction: float | None = None, seed: int = 42) -> DataFrame | None:
    """A catalog table or Parquet folder as a whole, or a sample of it; None if it does not exist."""
    try:
        df = spark.read.parquet(table) if "/" in table else spark.table(table)
    except AnalysisException:
        return None
    return df if fraction is None else df.sample(fraction=fraction, seed=seed)


def first_existing(spark: SparkSession, tables: Sequence[str], default_schema: str, default_row: Sequence[object]) -> DataFrame:
    """The first table of the list that exists, else one default row."""
    for table in tables:
        df = scan(spark, table)
        if df is not None:
            return df
    return spark.createDataFrame([tuple(default_row)], default_schema)
