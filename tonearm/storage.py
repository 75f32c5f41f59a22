"""Where intermediate tables go: the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only for local masters without the setting."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tonearm-checkpoint-")
    if sc.getCheckpointDir() is None:
        # Spark makes a folder of the application's own under the path; it goes with the application.
        sc.setCheckpointDir(path)
        drop_at_exit(spark, sc.getCheckpointDir())
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """A written intermediate goes when the application ends; its readers are lazy, so not before."""
    target, fs = _file_system(spark, path)
    fs.deleteOnExit(target)


def materialize(df: DataFrame, name: str, under: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, computes once.

    ``under`` is a folder of the caller's own from :func:`fresh_path`, for tables that it will :func:`remove` together once what comes of them is written.
    """
    path = f"{under}/{name}" if under else fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    drop_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows from which a table is merged with what it is joined with. They change no result.
SENT_ROWS = 250_000


def joinable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, a stored or written table, for joins with tables of its size: merged, not broadcast, where it has over SENT_ROWS rows.

    Spark judges a table by the bytes of its files, which ids and repeated values keep many times smaller than the rows that the driver would hold and send.
    What is selected, filtered or grouped from it keeps to that. It is counted here unless its ``rows`` are known.
    """
    return df.hint("merge") if (df.count() if rows is None else rows) > SENT_ROWS else df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate table through Hadoop's file system, wherever it is."""
    target, fs = _file_system(spark, path)
    fs.delete(target, True)
