"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local one only where that is unset and all runs on one machine (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quakeweave-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run here go as soon as it has ended, not when the driver next collects its garbage."""
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it again.

    The table survives the loss of any executor, so the shuffles that made it are not kept.
    It goes when the application ends, or by drop().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_drop_written)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete what written() stored for df, once nothing reads it any more."""
    for name in df.inputFiles()[:1]:
        for entry in list(_written):
            if entry[1].split("://")[-1] in name:
                _delete(*entry)
                _written.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; the shared folder is the cluster's to clean
            return
