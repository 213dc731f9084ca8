"""Shared scratch storage: where intermediate tables are cut from their lineage.

Executors may be lost at any time and share no local disk with the driver, so
an intermediate result is only ever written below ``spark.checkpoint.dir``. Only a
``local[n]`` session, where one machine is all there is, may go without that setting.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a session on one machine (tests) gets one of its own if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="driftgrid-"))
    return context.getCheckpointDir().get().rstrip("/")


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and return the table read back.

    The written table survives lost executors, is read column by column, and is
    removed by :func:`drop`, or else when the driver's JVM exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftgrid-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place.getParent())
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder on any storage that Spark reaches; nothing happens if it is not there."""
    place, files = _place(spark, path)
    files.delete(place, True)


def drop(*tables: DataFrame) -> None:
    """Remove tables of :func:`materialize` that nothing reads any more."""
    for table in tables:
        delete(table.sparkSession, table.scratch_path.rsplit("/", 1)[0])
