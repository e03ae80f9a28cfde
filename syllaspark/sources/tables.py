"""Tables that are read more than once, scans that are too few for the cores, and this package's code on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


#: Bytes of a scan, as stored, that make a task of their own.
PART_BYTES = 400_000
_SCOPE: ContextVar[list[DataFrame] | None] = ContextVar("kept_tables", default=None)


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept on the executors, in memory or on disk; what a lost executor had is computed again."""
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    if (scope := _SCOPE.get()) is not None:
        scope.append(out)
    return out


@contextmanager
def keeping() -> Iterator[None]:
    """Tables that are kept inside are given up at the end."""
    tables: list[DataFrame] = []
    token = _SCOPE.set(tables)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for t in tables:
            t.unpersist()


def spread(df: DataFrame) -> DataFrame:
    """A scan, dealt over the cores where it has fewer partitions than there are, one for each PART_BYTES at most; larger inputs have more and aren't shuffled, nor is anything that was shuffled before."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = min(df.sparkSession.sparkContext.defaultParallelism, size // PART_BYTES + 1)
    # A file may be one row group, which one task reads whatever the number of splits is, so equal numbers count as few.
    return df.repartition(parts) if 1 < parts and plan.execute().getNumPartitions() <= parts else df


def ship(spark: SparkSession) -> None:
    """Makes this package importable for the executors' Python workers, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_syllaspark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), "syllaspark_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    sc._syllaspark_shipped = True
