"""Keyed upserts of a stream of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.ingest import latest, upsert
from ..plans.steps import shared_folder


def upsert_stream(spark: SparkSession, path: str, keys: list[str], order: str, columns: list[str], name: str | None = None) -> DataFrame:
    """The table that the files at path give when they arrive as a stream: each micro-batch is upserted into a version
    of the table in the shared folder, and a batch that runs again writes the same version anew.

    With a name, progress and versions stay under it: a driver that starts again goes on after the last batch that was
    done, with the version before it. The two last versions are kept.
    """
    base = f"{shared_folder(spark)}/stream-{name or uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    source = reader.parquet(path) if _status(spark, path).isDirectory() else reader.option("pathGlobFilter", file).parquet(folder)

    def merge(batch: DataFrame, number: int) -> None:
        new = latest(batch.select(columns), keys, order)
        before = [v for v in _versions(spark, base) if v < number]
        old = spark.read.parquet(f"{base}/v{before[-1]}") if before else spark.createDataFrame([], new.schema)
        upsert(old, new, keys, order).write.mode("overwrite").parquet(f"{base}/v{number}")
        for v in before[:-1]:
            _delete(spark, f"{base}/v{v}")

    source.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    done = _versions(spark, base)
    return spark.read.parquet(f"{base}/v{done[-1]}") if done else spark.createDataFrame([], schema).select(columns)


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _status(spark: SparkSession, path: str):
    system, at = _path(spark, path)
    return system.getFileStatus(at)


def _delete(spark: SparkSession, path: str) -> None:
    system, at = _path(spark, path)
    system.delete(at, True)


def _versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the versions that were written to their end."""
    system, at = _path(spark, base)
    if not system.exists(at):
        return []
    names = [s.getPath().getName() for s in system.listStatus(at)]
    of = lambda n: _path(spark, f"{base}/{n}/_SUCCESS")
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and (f := of(n))[0].exists(f[1]))
