"""Session settings and tables written to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # text work is heavy per byte: small shuffles still use all cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.files.openCostInBytes": "1m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the session options the operators rely on."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for this application's written tables.

    Below ``spark.checkpoint.dir``, or where that is not set, below the warehouse, which all machines share as well. The
    folder is removed when the application ends.
    """
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    folder = f"{top}/albumetry/{sc.applicationId}"
    if folder not in _marked:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _marked.add(folder)
    return folder


_marked: set[str] = set()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage for loops and gives the planner real sizes; lost executors
    re-read the files instead of recomputing.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
