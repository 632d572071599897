"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a file of a narrow table whose size is known.
FILE_ROWS = 1 << 18
_made: dict[str, SparkSession] = {}
#: Removes the shuffle files of an execution when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new
    local folder is set for a session on one machine; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="assayer-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, so that a lost executor
    costs a read and not the work before. What was shuffled for it goes at once; the table goes with
    dropped() or when the driver ends. rows says how many rows there are at most, where that is known
    and the last step is a light one: then no more files are written than they need."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(-(-max(rows, 1) // FILE_ROWS))
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def folder(spark: SparkSession, tag: str) -> str:
    """A new name in the shared folder for files of other kinds; it goes when the driver ends."""
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def _remove(path: str) -> None:
    spark = _made.pop(path, None)
    if spark is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by stored() that nothing reads any more. Other frames are left alone."""
    for t in tables:
        if path := getattr(t, "_stored_at", None):
            _remove(path)


def _remove_stored() -> None:
    for path in list(_made):
        try:
            _remove(path)
        except Exception:  # the session may be gone
            return


atexit.register(_remove_stored)
