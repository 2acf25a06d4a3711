"""Tables that an operator writes between its rounds, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[object, object]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session in one process may do without that setting, any other may not."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path, deleted when the session's program ends."""
    path = f"{shared_folder(spark)}/rounds/{uuid.uuid4().hex}/{name}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    _written.append((where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where))
    return path


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as it reads from a Parquet table at ``path``: its lineage ends there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    return written(df, new_folder(df.sparkSession, name))


@atexit.register
def _delete() -> None:
    for fs, where in _written:
        try:
            fs.delete(where, True)
        except Exception:  # the JVM may be gone
            return
