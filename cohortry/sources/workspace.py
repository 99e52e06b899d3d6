"""The shared folder that stages are written to.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``, so a lost
executor costs a re-read and never a recomputation of the whole lineage. A folder of our own is
made only for a local master that names none (tests).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the session."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="cohortry-")
    return _local_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; never reused, so no run reads another's files."""
    path = f"{shared_dir(spark).rstrip('/')}/cohortry/{label}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


def file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """Hadoop's file system for a path, and the path in its terms."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what was written to the shared folder inside.

    Write or collect the results before leaving: tables built inside may still read those files.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            system, where = file_system(spark, path)
            system.delete(where, True)


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, fixes the rows.

    Use it where a value must not change between two uses (a partition number) or where a loop
    would otherwise grow the plan.
    """
    path = new_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
