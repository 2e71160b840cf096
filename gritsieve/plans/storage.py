"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """What the session names in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder of this machine serves a session that runs on this
    machine alone; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "gritsieve")


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a small file wherever Spark can write."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()


def forget(spark: SparkSession, path: str) -> str:
    """Has ``path`` deleted with the tables of :func:`materialize`."""
    _written.append((spark, path))
    return path


def delete_tables() -> None:
    """Removes what :func:`materialize` has written; results that read it become unreadable."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended before
            return


def drop(table: DataFrame) -> None:
    """Removes one table of :func:`materialize`, which nothing will read any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if re.fullmatch("table-[0-9a-f]{32}", folder.rsplit("/", 1)[-1]):
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


atexit.register(delete_tables)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    spark.sparkContext._jvm.System.gc()  # lets go of shuffle files that nothing needs any more
    return spark.read.schema(df.schema).parquet(path)
