"""Session defaults of the library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "runledger", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew-join handling; conf overrides, with _ for dots."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode a local one where it is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Folders that this process has named since the last removal.
_NAMED: list[str] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A folder of its own in the shared one."""
    _NAMED.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _NAMED[-1]


def remove_written(spark: SparkSession) -> int:
    """Deletes what this process has written to folders of fresh_path(); returns how many there were.

    For the end of a run: frames that read them, also results that are not written elsewhere, can't be computed any more.
    """
    removed = 0
    for name in _NAMED:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        removed += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _NAMED.clear()
    return removed


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: it is computed once, its lineage is cut, lost executors don't matter."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
