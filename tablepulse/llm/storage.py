"""Shared folders, cut lineage and shipped code for the operators of this folder."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tablepulse.session import shared_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Give the executors this package, unless their import path already has it."""
    path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    context = spark.sparkContext
    if str(ROOT) in path or getattr(context, "_tablepulse_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="tablepulse-code-")) / "tablepulse.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((ROOT / "tablepulse").rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    context.addPyFile(str(archive))
    context._tablepulse_shipped = True


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}"


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read column by column.

    The shuffle files of the write are dropped at its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def give_back() -> None:
    """Return memory that the allocators of this process keep to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], clear: Callable[[], None] | None = None):
    """``run`` for ``mapInArrow`` that gives its memory back when the task ends.

    Workers live on for the tasks of other stages; what allocators keep would add up over the stages
    of a pipeline.  ``clear`` empties caches of the operator.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if clear:
                clear()
            give_back()

    return tidy
