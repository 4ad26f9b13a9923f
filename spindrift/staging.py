"""Tables that cut a lineage: written to the folder all executors share and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Only a local session, whose executors are this process, gets one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: df as a Parquet table in the shared folder, and its path."""
    path = f"{shared_dir(df.sparkSession)}/spindrift-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _staged[path] = None
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes staged tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _staged.pop(path, None)


def staged() -> set[str]:
    """Paths of all tables that are staged now."""
    return set(_staged)


def clear(spark: SparkSession) -> None:
    """Removes every table that is still staged, once the results that read them are written."""
    drop(spark, *_staged)
