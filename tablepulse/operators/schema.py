"""Schema inference over whole tables, fingerprints, diffs and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.functions.names import short_hash
from tablepulse.functions.types import TEXT, logical_type, looks_boolean, looks_numeric, parse_time

# Names inside stored schema documents and kinds of change.
SCHEMA_JSON = "array<struct<name:string,snowflake_type:string,pandas_dtype:string,nullable:boolean>>"
ADDED, RETYPED, DROPPED = "ADD_COLUMN", "TYPE_CHANGE", "DROP_COLUMN"


# Slots per column in the first pass over the sample keys.
SAMPLE_SLOTS = 64


class EmptyTableError(ValueError):
    """A schema cannot be inferred without columns and rows."""


def _missing(column: Column, data_type: T.DataType) -> Column:
    """NULL, or NaN in a floating-point column."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def infer_schema(df: DataFrame) -> DataFrame:
    """One row per column: position, name, logical type, storage type, nullable.

    A single aggregation counts, for every column at once, the missing values and
    (for text) how many values read as a number, a time or a boolean.  A text
    column is promoted when all of its values agree.
    """
    if not df.columns:
        raise EmptyTableError("no columns to infer a schema from")
    measures: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(df.schema.fields):
        column = F.col(f"`{field.name}`")
        measures.append(F.count_if(_missing(column, field.dataType)).alias(f"missing_{i}"))
        if isinstance(field.dataType, T.StringType):
            measures += [
                F.count_if(looks_numeric(column)).alias(f"numeric_{i}"),
                F.count_if(column.contains(".")).alias(f"dotted_{i}"),
                F.count_if(parse_time(column).isNotNull()).alias(f"time_{i}"),
                F.count_if(looks_boolean(column)).alias(f"boolean_{i}"),
            ]
    totals = df.agg(*measures)

    described = []
    for i, field in enumerate(df.schema.fields):
        if isinstance(field.dataType, T.StringType):
            filled = F.col("rows") - F.col(f"missing_{i}")
            kind = (
                F.when(filled == 0, F.lit(TEXT))
                .when((F.col(f"numeric_{i}") == filled) & (F.col(f"dotted_{i}") > 0), F.lit("FLOAT"))
                .when(F.col(f"numeric_{i}") == filled, F.lit("NUMBER(18,0)"))
                .when(F.col(f"time_{i}") == filled, F.lit("TIMESTAMP_NTZ"))
                .when(F.col(f"boolean_{i}") == filled, F.lit("BOOLEAN"))
                .otherwise(F.lit(TEXT))
            )
        else:
            kind = F.lit(logical_type(field.dataType))
        described.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("column_name"),
                kind.alias("logical_type"),
                F.lit(field.dataType.simpleString()).alias("storage_type"),
                (F.col(f"missing_{i}") > 0).alias("nullable"),
                F.col("rows").alias("rows"),
            )
        )
    return totals.select(F.inline(F.array(*described))).filter(F.col("rows") > 0).drop("rows")


# Storage of the logical types that texts are promoted to.
STORAGE = {"NUMBER(18,0)": "bigint", "FLOAT": "double", "TIMESTAMP_NTZ": "timestamp_ntz", "BOOLEAN": "boolean"}


def promoted(df: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, Column]:
    """``df`` with text columns cast to their inferred types, and a condition on rows that lost a value."""
    out, lost = [], F.lit(False)
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = STORAGE.get(kinds.get(field.name, "")) if isinstance(field.dataType, T.StringType) else None
        if kind:
            text = column
            column = parse_time(text).cast(kind) if kind == "timestamp_ntz" else F.trim(text).try_cast(kind)
            lost = lost | (text.isNotNull() & column.isNull())
        out.append(column.alias(field.name))
    return df.select("*", lost.alias("_lost")).select(*out, "_lost"), F.col("_lost")


def sample_values(df: DataFrame, order_key: str, n: int = 5) -> DataFrame:
    """The first ``n`` present values of each column in the order of ``order_key``.

    A first pass takes the smallest key of each of many hash slots per column.  The
    n-th smallest of these bounds the n-th smallest key of all, so that the second
    pass only has to rank the few rows up to that bound.  No pass sorts the table.
    """
    names = [c for c in df.columns if not c.startswith("_") and c != order_key]
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("column_id"), F.col(f"`{c}`").cast("string").alias("sample_value"))
            for i, c in enumerate(names)
        ]
    )
    long = df.select(F.col(order_key).alias("_order"), F.inline(cells)).filter(F.col("sample_value").isNotNull())

    slot = F.pmod(F.xxhash64("_order"), F.lit(SAMPLE_SLOTS))
    smallest = long.groupBy("column_id", slot.alias("slot")).agg(F.min("_order").alias("_order"))
    # At most SAMPLE_SLOTS keys per column.
    keys = F.sort_array(F.collect_list("_order"))
    bounds = smallest.groupBy("column_id").agg(
        F.when(F.size(keys) >= n, F.get(keys, F.lit(n - 1))).alias("bound")
    )
    near = long.join(F.broadcast(bounds), "column_id").filter(
        F.col("bound").isNull() | F.col("_order").isNull() | (F.col("_order") <= F.col("bound"))
    )
    rank = F.row_number().over(Window.partitionBy("column_id").orderBy("_order", "sample_value"))
    name = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("column_id") + 1)
    return (
        near.withColumn("sample_no", rank)
        .filter(F.col("sample_no") <= n)
        .select(name.alias("column_name"), "sample_no", "sample_value")
    )


def schema_documents(columns: DataFrame, *keys: str) -> DataFrame:
    """Schema rows as one JSON document per key, in column order and without samples."""
    entry = F.struct(
        F.col("position"),
        F.to_json(
            F.struct(
                F.col("column_name").alias("name"),
                F.col("logical_type").alias("snowflake_type"),
                F.col("storage_type").alias("pandas_dtype"),
                F.col("nullable"),
            )
        ).alias("json"),
    )
    ordered = F.sort_array(F.collect_list(entry))
    return columns.groupBy(*keys).agg(
        F.concat(F.lit("["), F.array_join(ordered["json"], ","), F.lit("]")).alias("schema_json")
    )


def parse_schema(document: Column) -> Column:
    return F.from_json(document, SCHEMA_JSON)


def explode_schema(versions: DataFrame, *keys: str) -> DataFrame:
    """One row per column of each stored schema document."""
    return versions.select(*keys, F.inline(parse_schema(F.col("schema_json")))).select(
        *keys, F.col("name").alias("column_name"), F.coalesce("snowflake_type", F.lit(TEXT)).alias("logical_type")
    )


def canonical_text(columns: Column) -> Column:
    """JSON text of ``array<struct<column_name, logical_type>>``, sorted by name."""
    def quoted(text: Column) -> Column:
        return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))

    entries = F.transform(
        F.sort_array(columns),
        lambda c: F.concat(
            F.lit('{"name": '), quoted(c["column_name"]), F.lit(', "type": '), quoted(c["logical_type"]), F.lit("}")
        ),
    )
    return F.concat(F.lit("["), F.array_join(entries, ", "), F.lit("]"))


def fingerprints(columns: DataFrame, *keys: str) -> DataFrame:
    """16-digit fingerprint per schema, independent of column order.

    A schema holds as many rows as a table has columns, so a group stays small.
    """
    pairs = F.collect_list(F.struct("column_name", "logical_type"))
    return columns.groupBy(*keys).agg(short_hash(canonical_text(pairs)).alias("fingerprint"))


def schema_changes(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Added, retyped and dropped columns between two schemas (per key)."""
    on = [*keys, "column_name"]
    both = old.select(*on, F.col("logical_type").alias("old_type")).join(
        new.select(*on, F.col("logical_type").alias("new_type")), on, "full_outer"
    )
    kind = (
        F.when(F.col("old_type").isNull(), F.lit(ADDED))
        .when(F.col("new_type").isNull(), F.lit(DROPPED))
        .when(F.col("old_type") != F.col("new_type"), F.lit(RETYPED))
    )
    detail = (
        F.when(
            F.col("change_type") == ADDED,
            F.concat(F.col("column_name"), F.lit(" was added as "), F.col("new_type")),
        )
        .when(
            F.col("change_type") == DROPPED,
            F.concat(F.col("column_name"), F.lit(" is missing from now on, it was "), F.col("old_type")),
        )
        .otherwise(F.concat(F.col("column_name"), F.lit(" was "), F.col("old_type"), F.lit(" and is "), F.col("new_type")))
    )
    return (
        both.withColumn("change_type", kind)
        .filter(F.col("change_type").isNotNull())
        .select(*keys, "column_name", "change_type", detail.alias("detail"))
    )


def change_summaries(changes: DataFrame, *keys: str) -> DataFrame:
    """``TYPE: column; …`` text per key: added and retyped columns first, dropped ones last."""
    entry = F.struct(
        (F.col("change_type") == DROPPED).alias("last"),
        F.col("column_name"),
        F.concat_ws(": ", "change_type", "column_name").alias("text"),
    )
    ordered = F.sort_array(F.collect_list(entry))
    return changes.groupBy(*keys).agg(F.array_join(ordered["text"], "; ").alias("change_summary"))
