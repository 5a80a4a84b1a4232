"""Files that driver and executors share: where tables on the way to a result go, what a folder holds."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str | None:
    """The session's `spark.checkpoint.dir`, in a folder of the application.

    Where that is unset, a new folder of this machine if it is the only one, else None: there is no
    other place that all machines are sure to see.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (context.master == "local" or context.master.startswith("local[")):
            return None
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="shared-")
        root = _own[context.applicationId]
    return f"{root.rstrip('/')}/{context.applicationId}"


def shared_path(spark: SparkSession, what: str) -> str | None:
    """A new path below `shared_root`."""
    root = shared_root(spark)
    return root and f"{root}/{what}-{uuid.uuid4().hex}"


def required_path(spark: SparkSession, what: str) -> str:
    path = shared_path(spark, what)
    if path is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return path


def found_files(spark: SparkSession, pattern: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of what matches a pattern, by path, on any file system of Spark."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    status = files.globStatus(place) or []
    return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in status)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder with all that it holds."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def state_of(spark: SparkSession, pattern: str) -> str:
    """A name for the present content of the matching files; another one once any is rewritten."""
    files = found_files(spark, pattern) + found_files(spark, f"{pattern.rstrip('/')}/*")
    return hashlib.sha256(repr(files).encode()).hexdigest()[:16]
