"""Tables of our own in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; one of our own where it is unset, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewater-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, partition_by: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, fixes the rows."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex}"
    out = df.write.options(**options or {})
    out = out.partitionBy(partition_by) if partition_by else out
    out.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._tidewater_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table made by ``written`` once nothing reads it any more."""
    spark, path = table.sparkSession, table._tidewater_path
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
