"""What the operators need from a session: tables, a shared folder and sizes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship as ship_package
from ..session import table

__all__ = ["cut", "free_name", "lean", "shared_dir", "ship", "shuffle_partitions", "table"]


#: Rows of an Arrow batch: whole texts go to Python workers, so the default of 10,000 would hold much at once.
BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> SparkSession:
    """The package on the workers, and small Arrow batches unless the session has a number of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))
    return ship_package(spark)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="tilewright-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; a lost executor loses none of it.

    Spark removes the shuffle files of plans that are gone only when the driver collects its garbage, which may be
    half an hour later; operators of many steps ask for it at each, so that earlier steps' files do not pile up.
    """
    shared_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Ask for the removal of the shuffle files of steps that are over; before a last, large step that is not cut."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return a worker's freed memory to the system: it lives on for later stages, beside other workers and the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which a task's memory is given back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
