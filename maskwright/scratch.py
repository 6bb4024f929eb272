"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The session's shared folder; a temporary folder only where none is set (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="maskwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Folders of this driver's intermediate tables that are still there.
_written: dict[str, None] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, deleted by `clear` or at the end of the driver's process."""
    path = f"{scratch_root(spark)}/maskwright/{name}-{uuid.uuid4().hex}"
    _written[path] = None
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and return a reader of it.

    The lineage ends at the files, which survive lost executors. They stay until `discard`, `clear` or the end of the
    driver's process.
    """
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this driver; results that were not written yet can no longer be read."""
    for path in list(_written):
        _delete(spark, path)


@atexit.register
def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if _written and spark is not None and spark.sparkContext._jsc is not None:
        clear(spark)


def local_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table of known size, planned as a JSON literal: no RDD and no Python worker."""
    names = [part.split()[0] for part in ddl.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(':'.join(p.split(None, 1)) for p in ddl.split(', '))}>>")))
