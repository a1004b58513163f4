"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``, so a lost
executor costs a re-read and not a recomputation of everything before.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_PATH = "_docmill_path"


def shared_root(spark: SparkSession) -> str:
    """The run's own folder below the shared checkpoint folder.

    ``spark.checkpoint.dir`` names it. Where that is unset, a session on this
    machine alone gets a temporary folder; on a cluster that is an error, as
    executors would write to their own disks.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if context.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="docmill-")
        _ROOTS[app] = f"{base.rstrip('/')}/docmill-{uuid.uuid4().hex}"
        _remove_at_end(spark, _ROOTS[app])
    return _ROOTS[app]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_at_end(spark: SparkSession, root: str) -> None:
    """Have the folder deleted when the session is stopped, or else when Python ends."""
    context = spark.sparkContext
    stop, app = context.stop, context.applicationId

    def clean() -> None:
        if _ROOTS.pop(app, None) is not None and context._jsc is not None:
            _delete(spark, root)

    def stopped() -> None:
        try:
            clean()
        finally:
            stop()

    context.stop = stopped
    atexit.register(clean)


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, *, compression: str | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and return the reread table.

    The shuffle files of the write go with it: only the table is read later.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def discard(table: DataFrame) -> None:
    """Delete a table that materialise returned; all that reads it must have been written by then."""
    _delete(table.sparkSession, getattr(table, _PATH))
