"""Column and table names, keys and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_name(name: Column, position: Column | int = 0) -> Column:
    """Lower-case identifier made of ``[a-z0-9_]``.

    Runs of other characters become one underscore, outer underscores go, and a
    leading digit gets the prefix ``col_``.  A name with nothing left becomes
    ``col_`` plus its position.
    """
    position = F.lit(position) if isinstance(position, int) else position
    body = F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_")
    body = F.regexp_replace(body, "_+", "_")
    body = F.regexp_replace(body, "^_|_$", "")
    return (
        F.when(body == "", F.concat(F.lit("col_"), position.cast("string")))
        .when(body.rlike("^[0-9]"), F.concat(F.lit("col_"), body))
        .otherwise(body)
    )


def clean_columns(df: DataFrame) -> DataFrame:
    """Rename all columns of ``df`` by the rule of :func:`clean_name`.

    Names that collide after cleaning get the next free number as suffix.
    """
    renamed: list[str] = []
    for position, original in enumerate(df.columns):
        name = re.sub("[^a-z0-9]+", "_", original.lower()).strip("_")
        if not name or name[0].isdigit():
            name = f"col_{name or position}"
        free, number = name, 1
        while free in renamed:
            number += 1
            free = f"{name}_{number}"
        renamed.append(free)
    return df.toDF(*renamed)


def snake_name(name: Column) -> Column:
    """Trimmed and lower-case, with blanks and dashes as underscores."""
    return F.translate(F.lower(F.trim(name)), " -", "__")


def bronze_name(dataset: Column) -> Column:
    body = F.regexp_replace(F.lower(dataset), "[^a-z0-9_]", "_")
    return F.concat(F.regexp_replace(body, "^_+|_+$", ""), F.lit("_raw"))


def silver_name(bronze: Column) -> Column:
    return F.concat(F.regexp_replace(F.lower(bronze), "_raw$", ""), F.lit("_silver"))


def gold_name(silver: Column) -> Column:
    return F.concat(F.regexp_replace(F.lower(silver), "_silver$", ""), F.lit("_gold"))


def event_table_name(dataset: Column, suffix: str) -> Column:
    """Table name derived from the dataset name carried by an event."""
    return F.concat(F.translate(F.lower(dataset), "-", "_"), F.lit(f"_{suffix}"))


def row_key(loaded_at: Column, row_number: Column, *scope: Column) -> Column:
    """MD5 key of scope, load time (millisecond text) and row number; NULL parts are left out."""
    stamp = F.date_format(loaded_at, "yyyy-MM-dd HH:mm:ss.SSS")
    return F.md5(F.concat_ws("|", *scope, stamp, row_number.cast("string")))


def short_hash(text: Column) -> Column:
    """First 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def label(*parts: Column | str) -> Column:
    """First non-NULL part, else ``unknown``."""
    return F.coalesce(*[F.col(p) if isinstance(p, str) else p for p in parts], F.lit("unknown"))


def run_label(dag_id: Column, run_id: Column) -> Column:
    return F.concat(F.coalesce(dag_id, F.lit("run")), F.lit(" · "), F.right(run_id, F.lit(8)))
