"""Session and DataFrame helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set: a temporary one on a local master, an error on a cluster."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="ckpt-"))
        found = sc.getCheckpointDir()
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """Small or middling intermediate results: a reliable checkpoint, which Spark removes when unused."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder when the application ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def stored(df: DataFrame) -> DataFrame:
    """Large intermediate results: a compressed table in the shared folder, read back, and deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """stored(), as a table in n buckets of key, so that a grouping by key needs no shuffle of it. The catalogue keeps no entry: the table is read by what it said of the files."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tables/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name)
    delete_at_end(spark, path)
    found = spark.table(name)
    spark.sql(f"drop table {name}")  # an outer table: its files stay
    return found


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col(quoted(c)) for c in df.columns]


def map_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema: T.StructType) -> DataFrame:
    """df.mapInArrow() for columns of any name; run gets them by their places."""
    names = [f"c{i}" for i in range(len(schema.fields))]

    def renamed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    plain = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema.fields, strict=True)])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(renamed, plain).toDF(*schema.names)


def free(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Keys of more rows than this are broadcast, and at most so many of them: the least number of rows grows with the table.
HOT, MOST_HOT = 10_000, 100_000


def spread_join(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined to found, which has one row a key and in n how many of the total rows have it at most.

    Keys with many rows, fewer than MOST_HOT keys, are broadcast, so that no key of rows
    becomes one task; the others are shuffled. rows is read twice.
    """
    bound = max(HOT, total // MOST_HOT)
    new = [c for c in found.columns if c not in (key, "n")]
    hot = found.filter(F.col("n") > bound).select(key, F.struct(*new).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    many = marked.filter("_hot is not null").select(*columns(rows), *(F.col("_hot")[c].alias(c) for c in new))
    few = marked.filter("_hot is null").drop("_hot").join(found.filter(F.col("n") <= bound).drop("n"), key)
    return many.unionByName(few)


def ordered_ids(rows: DataFrame, name: str) -> DataFrame:
    """name (not null) and n: its distinct values numbered in their own order, by ranges, so that no task sorts all."""
    each = checkpointed(rows.filter(F.col(name).isNotNull()).select(name).distinct().repartitionByRange(partitions(rows.sparkSession), name).sortWithinPartitions(name).select(name, F.spark_partition_id().alias("_p"), (F.monotonically_increasing_id() % (1 << 33)).alias("_k")))
    before, starts = 0, []
    for p, n in sorted((r[0], r[1]) for r in each.groupBy("_p").count().collect()):  # one row a partition
        starts.append((p, before))
        before += n
    at = rows.sparkSession.createDataFrame(starts, "_p int, _before long")
    return each.join(F.broadcast(at), "_p").select(name, (F.col("_k") + F.col("_before")).alias("n"))
