"""Sessions: the package on the executors, and tables of a folder."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
#: Rows that one task is to sort or group.
ROWS = 500_000


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: from PYTHONPATH if it is there, else as a zip that Spark sends out."""
    app = spark.sparkContext.applicationId
    if app not in _shipped and str(ROOT) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        folder = Path(tempfile.mkdtemp(prefix="tilewright-ship-"))
        (folder / "src").mkdir()
        shutil.copytree(ROOT / "tilewright", folder / "src/tilewright", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(str(folder / "tilewright"), "zip", folder / "src"))
        shutil.rmtree(folder / "src")
    _shipped.add(app)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys over as many tasks as the session shuffles with: rows that one small file holds may each be long work.

    The number is given, so that adaptive execution does not put them together again by their few bytes. It is one more than
    the session's, as a shuffle by the same keys below, as of a group, would otherwise stand for this one, and be put together.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, *keys)


def tasks_for(df: DataFrame) -> int:
    """As many tasks as the session shuffles with, or more where each would get over ``ROWS`` rows of ``df``, which is counted."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="tilewright-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the folder that driver and executors share."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
