"""Logical type names, type families and tolerant conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Logical type names per family.
FAMILIES = {
    "numeric": ["NUMBER", "DECIMAL", "NUMERIC", "INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT",
                "BYTEINT", "FLOAT", "FLOAT4", "FLOAT8", "DOUBLE", "REAL"],
    "string": ["VARCHAR", "CHAR", "CHARACTER", "STRING", "TEXT", "BINARY", "VARBINARY"],
    "bool": ["BOOLEAN"],
    "date": ["DATE", "DATETIME", "TIME", "TIMESTAMP", "TIMESTAMP_LTZ", "TIMESTAMP_NTZ", "TIMESTAMP_TZ"],
}
# Logical name of each physical type.
LOGICAL = {
    T.ByteType: "NUMBER(5,0)",
    T.ShortType: "NUMBER(7,0)",
    T.IntegerType: "NUMBER(10,0)",
    T.LongType: "NUMBER(18,0)",
    T.FloatType: "FLOAT",
    T.DoubleType: "FLOAT",
    T.BooleanType: "BOOLEAN",
    T.TimestampNTZType: "TIMESTAMP_NTZ",
    T.TimestampType: "TIMESTAMP_LTZ",
    T.DateType: "DATE",
    T.DayTimeIntervalType: "VARCHAR(100)",
}
TEXT = "VARCHAR(65535)"
# Texts that stand for a boolean, and what counts as a number or a time.
BOOLEAN_TEXTS = ["true", "false", "1", "0", "yes", "no", "t", "f"]
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|[iI][nN][fF]|[iI]nfinity|[nN]a[nN])\s*$"
TIME_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
TIME_FORMATS = {
    r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$": "MM/dd/yyyy",
    r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$": "yyyy/MM/dd",
    r"^[0-9]{2}-[A-Z][a-z]{2}-[0-9]{4}$": "dd-MMM-yyyy",
    r"^[0-9]{2}/[0-9]{2}/[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}$": "MM/dd/yyyy HH:mm:ss",
}


def logical_type(data_type: T.DataType) -> str:
    """Logical type name of a Spark type; unknown and nested types are text."""
    if isinstance(data_type, T.DecimalType):
        return f"NUMBER({data_type.precision},{data_type.scale})"
    return LOGICAL.get(type(data_type), TEXT)


def spark_family(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "string"


def fits_family(data_type: T.DataType, family: str) -> bool:
    """Whether values of a Spark type may stand in a column of this family.

    A boolean column also accepts text and whole numbers, and an unknown family
    accepts everything.
    """
    actual = spark_family(data_type)
    if family == "bool":
        return actual in ("bool", "string") or isinstance(data_type, T.IntegralType)
    return family == "unknown" or actual == family


def type_family(type_name: Column) -> Column:
    """Family of a logical type name, read up to its first parenthesis."""
    base = F.upper(F.trim(F.substring_index(type_name, "(", 1)))
    family = F.when(F.lit(False), F.lit(""))
    for name, members in FAMILIES.items():
        family = family.when(base.isin(members), F.lit(name))
    return family.otherwise(F.lit("unknown"))


def family_of(type_name: str) -> str:
    base = type_name.upper().split("(")[0].strip()
    return next((family for family, members in FAMILIES.items() if base in members), "unknown")


def is_numeric_name(type_name: Column) -> Column:
    return F.upper(type_name).rlike("NUMBER|FLOAT|INT|DECIMAL|NUMERIC")


def looks_numeric(text: Column) -> Column:
    return text.rlike(NUMBER_PATTERN)


def parse_time(text: Column) -> Column:
    """Timestamp of a text in ISO form or one of ``TIME_FORMATS``, else NULL.

    A text is only parsed when its shape fits, because failed parses are slow.
    """
    out = F.when(text.rlike(TIME_PATTERN), F.try_to_timestamp(text))
    for pattern, time_format in TIME_FORMATS.items():
        out = out.when(text.rlike(pattern), F.try_to_timestamp(text, F.lit(time_format)))
    return out


def looks_boolean(text: Column) -> Column:
    return F.lower(text).isin(BOOLEAN_TEXTS)


def to_double(value: Column) -> Column:
    """Number in ``value``, or NULL when there is none."""
    return value.try_cast("double")
