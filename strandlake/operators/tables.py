"""Intermediate results as tables in a folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """That of spark.checkpoint.dir. Where it is unset: a temporary one on a local master, an error on a cluster."""
    given = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if given is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        given = tempfile.mkdtemp(prefix="tables-")
        spark.sparkContext.setCheckpointDir(given)
        given = spark.sparkContext.getCheckpointDir()
    return given


def stored(df: DataFrame) -> DataFrame:
    """df, computed now and read back from a compressed table, which goes when the application ends. Nothing is kept in memory, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
