"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; a temporary one only if that is unset and all of Spark is in
    one process, as in tests."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = base or tempfile.mkdtemp(prefix="pixeltide-")
        _FOLDERS[app] = f"{base.rstrip('/')}/pixeltide-tables-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_clear, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _clear(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then
        if spark.sparkContext._jsc is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """Written once and read again, for a table that several later passes read: it survives lost executors and is not
    computed anew for each pass."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
