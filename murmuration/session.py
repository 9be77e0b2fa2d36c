"""Session settings, and the shared folder in which long jobs keep intermediate results."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split a hot join key at run time even where that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # What a Python worker holds at once; texts are long.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def build_session(app_name: str = "murmuration", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the library's defaults; ``settings`` uses ``__`` for the dots of a setting's name."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="murmuration-"))
    return spark.sparkContext.getCheckpointDir()


def application_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables; ``clear`` removes it."""
    return f"{shared_folder(spark).rstrip('/')}/murmuration-{spark.sparkContext.applicationId}"


_scopes = threading.local()


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the innermost open ``scratch`` folder, else under the application's folder."""
    opened = getattr(_scopes, "folders", [])
    return f"{opened[-1] if opened else application_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside the block are removed at its end; results must be written elsewhere by then."""
    folder = new_folder(spark, "scratch")
    _scopes.folders = [*getattr(_scopes, "folders", []), folder]
    try:
        yield folder
    finally:
        _scopes.folders = _scopes.folders[:-1]
        delete_folder(spark, folder)


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` now into a table in the shared folder and read it from there.

    Later rounds neither recompute it nor depend on executors, and the planner knows its true size, so that small
    sides of joins are broadcast by measured size only.
    """
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(stored: DataFrame | None) -> None:
    """Delete a table that ``durable`` made, once nothing reads it any more; any other frame is left alone."""
    path = getattr(stored, "stored_at", None)
    if isinstance(path, str):
        delete_folder(stored.sparkSession, path)


def durable_with(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``durable`` that also evaluates aggregates of the rows while they are written, without another job."""
    seen = Observation()
    stored = durable(df.observe(seen, *[column.alias(name) for name, column in measures.items()]))
    return stored, seen.get


def clear(spark: SparkSession) -> None:
    """Remove the application's intermediate tables, once their results are no longer needed."""
    delete_folder(spark, application_folder(spark))
