"""Grouping and join keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A text longer than this is compared by its 64-digit SHA-256.
KEY_CHARS = 63
# Rows whose keys are estimated to be wider than this are compared by one digest.
KEY_BYTES = 256
# JSON of nested values, with times to the microsecond.
JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def compact_key(column: Column, data_type: T.DataType) -> Column:
    """Grouping key of bounded width that is equal exactly for equal values.

    Texts up to 63 characters stand for themselves and never meet a digest, which
    has 64.  Nested values are compared through their JSON text.
    """
    if _fixed_width(data_type):
        return column
    column = exact_text(column, data_type)
    return F.when(F.length(column) > KEY_CHARS, F.sha2(column, 256)).otherwise(column)


def _fixed_width(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def exact_text(column: Column, data_type: T.DataType) -> Column:
    """Text that is equal exactly for values that group together, to the microsecond.

    Times without zone never meet the session's zone, in which two of them can be one moment.
    """
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return (column + F.lit(0.0)).cast("string")  # -0.0 groups with 0.0
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(column).cast("string")
    if isinstance(data_type, T.BinaryType):
        return F.hex(column)
    if isinstance(data_type, T.StringType) or _fixed_width(data_type):
        return column.cast("string")
    return F.when(column.isNotNull(), F.to_json(column, JSON))


def row_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """All values of a row with their lengths; NULL has a mark of its own, so no two different rows share a text."""
    parts = []
    for c in columns:
        text = exact_text(F.col(f"`{c}`"), df.schema[c].dataType)
        parts.append(F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def row_keys(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Key columns that are equal exactly for rows equal in ``columns``.

    Narrow rows are their own key.  Wide rows are shuffled as the 32 bytes of a
    SHA-256 over all values, each written with its length so that no two different
    rows share a text.
    """
    kinds = {c: df.schema[c].dataType for c in columns}
    width = sum(8 if _fixed_width(kind) else 32 for kind in kinds.values())
    if width <= KEY_BYTES:
        return [compact_key(F.col(f"`{c}`"), kind) for c, kind in kinds.items()]
    return [F.unhex(F.sha2(row_text(df, columns), 256))]
