"""Reading uploaded CSV and JSON files into DataFrames with clean column names."""

from __future__ import annotations

import json
import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.functions.names import clean_columns
from tablepulse.functions.types import TIME_PATTERN
from tablepulse.sources.splits import FILE, ROW_NO, records

EXTENSIONS = {".csv": "csv", ".json": "json", ".jsonl": "json"}
CORRUPT = "_corrupt_record"
# Texts that stand for a missing value in a CSV file.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
]
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


class UnsupportedFileType(ValueError):
    """The file name has no extension, or one that no reader handles."""


class EmptyFile(ValueError):
    """The file holds no rows."""


class UnreadableFile(ValueError):
    """The file cannot be parsed."""


def file_extension(name: str) -> str:
    """Lower-case extension of a supported file."""
    stem, dot, tail = name.rpartition(".")
    extension = f".{tail.lower()}"
    if not dot or extension not in EXTENSIONS:
        raise UnsupportedFileType(name)
    return extension


def source_type(name: str) -> str:
    """``csv``, ``json`` or ``jsonl``; anything else counts as CSV."""
    tail = name.rpartition(".")[2].lower() if "." in name else ""
    return tail if tail in ("csv", "json", "jsonl") else "csv"


def read_file(
    spark: SparkSession, path: str, schema: T.StructType | None = None, rejects: bool = False, multi_line: bool = True,
    places: bool = False, landing: str | None = None,
) -> DataFrame:
    """Rows of a CSV or JSON file, or of a folder of files of one kind.

    Without ``schema`` the types are inferred from all values.  A malformed record
    is an error, for which all records are read once, or, with ``rejects``, stays in the
    column ``_corrupt_record`` for the quarantine.  Quoted CSV texts may hold line breaks;
    large files are split all the same (:mod:`tablepulse.sources.splits`).  ``multi_line=False``
    saves the scan that finds quotes, for files without line breaks in texts.

    With ``places`` the columns ``_file`` and ``_row_no`` tell where a record stands; they do not
    depend on the splits.  With ``landing``, a folder, the parsed records are written there once and
    all that follows reads them.
    """
    kind = EXTENSIONS[file_extension(path)]
    try:
        if kind == "csv":
            df = _read_csv(spark, path, schema, rejects, multi_line, places)
        else:
            df = _read_json(spark, path, schema, rejects, places)
        if landing is not None:
            df.write.mode("overwrite").parquet(landing)
            df = spark.read.schema(df.schema).parquet(landing)
        if kind == "csv" and schema is None:
            df = typed_texts(df)
        # Reading every column of every record finds the malformed ones.
        unread = rejects or landing is not None
        empty = df.isEmpty() if unread else not df.agg(F.count("*"), *[F.count(F.col(f"`{c}`")) for c in df.columns]).first()[0]
    except (PySparkException, Py4JJavaError) as error:
        raise UnreadableFile(path) from error
    if empty:
        raise EmptyFile(path)
    return _clean(df)


def _kept(df: DataFrame) -> list[str]:
    """Columns of the reader, which are no data."""
    return [c for c in (FILE, ROW_NO, CORRUPT) if c in df.columns]


def _clean(df: DataFrame) -> DataFrame:
    kept = _kept(df)
    renamed = clean_columns(df.drop(*kept)).columns
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in kept], *kept).toDF(*renamed, *kept)


def _mode(schema: T.StructType | None, rejects: bool) -> tuple[T.StructType | None, dict[str, str]]:
    if not rejects:
        return schema, {"mode": "FAILFAST"}
    if schema is not None:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def _parsed(found: DataFrame, record: Column, schema: T.StructType, places: bool) -> DataFrame:
    """The fields of a parsed record as columns."""
    parsed = found.select(*[c for c in (FILE, ROW_NO) if places], record.alias("_record"))
    fields = [F.col("_record").getField(c).alias(c) for c in schema.names]
    return parsed.select(*fields, *[c for c in (FILE, ROW_NO) if places])


def _read_csv(spark: SparkSession, path: str, schema: T.StructType | None, rejects: bool, multi_line: bool, places: bool) -> DataFrame:
    # A quote inside quotes is doubled.
    options = {"header": True, "escape": '"'}
    if schema is None:
        names = spark.read.options(**options, multiLine=multi_line).csv(path).columns
        if not names:
            raise EmptyFile(path)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    schema, mode = _mode(schema, rejects)
    if not (multi_line or places):
        return spark.read.options(**options, **mode).schema(schema).csv(path)
    found = records(spark, path, quoted=multi_line).where((F.col(ROW_NO) > 0) & (F.col("value") != ""))
    record = F.from_csv("value", F.lit(schema_text(schema)), {"escape": '"', "multiLine": "true", **mode})
    return _parsed(found, record, schema, places)


def schema_text(schema: T.StructType) -> str:
    """A schema in the form that parsing functions take, names quoted."""
    quote = lambda name: "`" + name.replace("`", "``") + "`"
    return ", ".join(f"{quote(f.name)} {f.dataType.simpleString()}" for f in schema.fields)


def typed_texts(df: DataFrame) -> DataFrame:
    """Text columns with marks of missing values as NULL, in the narrowest type that fits all their values."""
    kept = _kept(df)
    columns = [c for c in df.columns if c not in kept]
    if not columns:
        return df
    clean = df.select(*[F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(c) for c in columns], *kept)

    def tests(c: str) -> dict[str, Column]:
        text = F.col(f"`{c}`")
        return {
            "int": text.rlike(INTEGER) & text.try_cast("int").isNotNull(),
            "bigint": text.rlike(INTEGER) & text.try_cast("bigint").isNotNull(),
            "double": text.rlike(DECIMAL),
            "boolean": F.lower(text).isin("true", "false"),
            "date": text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & text.try_cast("date").isNotNull(),
            "timestamp": text.rlike(TIME_PATTERN) & text.try_cast("timestamp").isNotNull(),
        }

    fits = [
        F.bool_and(F.when(F.col(f"`{c}`").isNotNull(), test)).alias(f"{i} {kind}")
        for i, c in enumerate(columns)
        for kind, test in tests(c).items()
    ]
    # One row with six flags per column; NULL where a column has no value.
    found = clean.agg(*fits).first().asDict()
    out = []
    for i, c in enumerate(columns):
        kind = next((k for k in tests(c) if found[f"{i} {k}"]), "string")
        value = F.trim(F.col(f"`{c}`")) if kind != "string" else F.col(f"`{c}`")
        out.append(value.cast(kind).alias(c))
    return clean.select(*out, *kept)


def _one_document(spark: SparkSession, path: str) -> bool:
    """Whether the file is one JSON document over several lines, by its first line with text."""
    line = spark.read.text(path).filter(F.trim("value") != "").first()
    first = line["value"].strip() if line else ""
    if re.fullmatch(r"\[?\s*\{?", first):
        return first != ""
    try:
        json.loads(first)
    except ValueError:
        return first.startswith(("[", "{"))
    return False


def _read_json(spark: SparkSession, path: str, schema: T.StructType | None, rejects: bool, places: bool) -> DataFrame:
    """One document per line, as always in ``.jsonl`` files, or else one document in the whole file."""
    whole = source_type(path) != "jsonl" and _one_document(spark, path)
    if schema is None:
        inferred = spark.read.option("multiLine", whole).json(path).schema
        if whole and inferred.names == [CORRUPT]:
            # No document, so the first line may be one malformed record.
            whole, inferred = False, spark.read.json(path).schema
        if CORRUPT in inferred.names and (not rejects or len(inferred) == 1):
            raise UnreadableFile(path)
        schema = T.StructType([f for f in inferred.fields if f.name != CORRUPT])
    schema, options = _mode(schema, rejects)
    if whole or not places:
        return spark.read.schema(schema).options(multiLine=whole, **options).json(path)
    found = records(spark, path, quoted=False).where(F.trim("value") != "")
    return _parsed(found, F.from_json("value", schema, options), schema, places)


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined raw records of a file read with ``rejects``.

    Spark reads raw records alone only from a file that was landed (``landing`` of :func:`read_file`).
    """
    if CORRUPT not in df.columns:
        return df, df.limit(0)
    bad = F.col(CORRUPT).isNotNull()
    return df.filter(~bad).drop(CORRUPT), df.filter(bad).select(CORRUPT)
