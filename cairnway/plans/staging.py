"""Lineage cuts that survive lost executors.

Intermediate tables are written as Parquet under the shared folder named by
``spark.checkpoint.dir`` and read back.  Unlike a local checkpoint, every
executor can read the files again after another one is lost; unlike
``DataFrame.checkpoint`` the plan runs once, and the result keeps columnar
pruning and statistics.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
#: The tables that each application has staged and not deleted.
_OWNED: dict[str, list[str]] = {}


def staging_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Taken from ``spark.checkpoint.dir``.  Where that is unset and Spark runs in
    one process (tests), a temporary folder is used; on a cluster an unset
    folder is an error, because a machine-local one cannot be shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="spark-stage-")
    return _FALLBACK[app]


def _new_path(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/cairnway/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_folder(spark: SparkSession, label: str) -> Iterator[str]:
    """The name of a new shared folder, for files of any format; deleted at the end."""
    path = _new_path(spark, label)
    try:
        yield path
    finally:
        delete(spark, path)


def _written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = _new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    table, path = _written(df, label)
    _OWNED.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return table


def held(spark: SparkSession) -> int:
    """How many tables this application has staged and not deleted."""
    return len(_OWNED.get(spark.sparkContext.applicationId, []))


def clear(spark: SparkSession, since: int = 0) -> int:
    """Deletes what this application has staged, but for its first ``since`` tables, and says how many; for the end of a run, when its results are written."""
    owned = _OWNED.get(spark.sparkContext.applicationId, [])
    paths = owned[since:]
    del owned[since:]
    for path in paths:
        delete(spark, path)
    return len(paths)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``staged`` whose tables are deleted at the end; what outlives the block is staged by ``staged`` itself."""
    paths: list[str] = []

    def stage(df: DataFrame, label: str) -> DataFrame:
        table, path = _written(df, label)
        paths.append(path)
        return table

    try:
        yield stage
    finally:
        for path in paths:
            delete(spark, path)
