"""Joins by keys, and sums along an order, without a task for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import stored


def joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join in which null keys are equal; the keys are a's."""
    other = b.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    return a.join(other, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]).drop(*(f"_of_{k}" for k in keys))


def beside(df: DataFrame, keys: list[str], value: Column, name: str, size: int, after: bool) -> DataFrame:
    """df (start, id) with the value of the row after it, or before it, in the order of (start, id) within keys.

    Rows are sorted in bins of size; across bins it comes from a table of each bin's edge.
    """
    b = df.withColumn("_b", F.floor(F.col("start") / size)).withColumn("_v", value)
    shift, edge = (F.lead, F.min_by) if after else (F.lag, F.max_by)
    edges = b.groupBy(*keys, "_b").agg(edge("_v", F.struct("start", "id")).alias("_e")).withColumn("_e", shift("_e").over(W.partitionBy(*keys).orderBy("_b")))
    inside = b.withColumn("_i", shift("_v").over(W.partitionBy(*keys, "_b").orderBy("start", "id")))
    return joined(inside, edges, [*keys, "_b"]).withColumn(name, F.coalesce("_i", "_e")).drop("_b", "_v", "_i", "_e")


def with_row(df: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of its keys' row in one; without keys, one is a single row."""
    return joined(df, one, keys) if keys else df.join(F.broadcast(one))


#: Keys with more than this part of all rows are broadcast, so there are fewer such keys than this.
MOST_HOT = 4096


def frequency_joined(a: DataFrame, b: DataFrame, keys: list[str], n: str) -> DataFrame:
    """joined() of a to b, which has one row a key and in n (dropped) how many of a's rows have it.

    Keys of over a 4096th of the rows are broadcast, the others are shuffled, so however many
    rows share a key (the zeros of a track, the hits of one motif), no task gets them all:
    rows that the broadcast served go by a number of their own in the shuffle. Without keys b
    is a row.
    """
    if not keys:
        return a.join(F.broadcast(b.drop(n)))
    new = [c for c in b.columns if c not in (*keys, n)]
    split = b.join(F.broadcast(b.agg(F.sum(n).alias("_of_all")))).withColumn("_often", F.col(n) * MOST_HOT > F.col("_of_all"))
    other = [F.col(k).alias(f"_of_{k}") for k in keys]
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    hot = split.filter("_often").select(*other, F.struct(F.lit(1).alias("_"), *new).alias("_hot"))
    marked = a.join(F.broadcast(hot), same, "left").drop(*(f"_of_{k}" for k in keys))
    dealt = marked.withColumn("_deal", F.when(F.col("_hot").isNull(), -1).otherwise(F.monotonically_increasing_id() % MOST_HOT))
    minus_one = -F.least(F.col(n), F.lit(1)).cast("long")  # a literal would be taken out of the join's keys
    few = split.filter("not _often").select(*other, minus_one.alias("_few"), F.struct(F.lit(1).alias("_"), *new).alias("_cold"))
    met = dealt.join(few, [*same, F.col("_deal") == F.col("_few")], "left").withColumn("_row", F.coalesce("_hot", "_cold"))
    return met.filter("_row is not null").select(*a.columns, *(F.col("_row")[c].alias(c) for c in new))


def running_counts(df: DataFrame, column: str, keys: list[str], ranges: int = 64) -> DataFrame:
    """keys, column, _n, _below: each value, how many rows of its keys have it, and how many a smaller one (nulls first).

    Values are counted first. Sums run within ranges, which quantiles of the values delimit,
    and are shifted by the ranges before. The counts are stored when this is called.
    """
    counts = stored(df.groupBy(*keys, column).agg(F.count("*").alias("_n")))
    bounds = counts.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 10_000).alias("_bounds"))
    r = counts.join(F.broadcast(bounds)).withColumn("_r", F.coalesce(F.size(F.filter(F.array_distinct("_bounds"), lambda b: b < F.col(column))), F.lit(0))).withColumn("_r", F.greatest("_r", F.lit(0))).drop("_bounds")
    shift = r.groupBy(*keys, "_r").agg(F.sum("_n").alias("_s")).withColumn("_before", F.sum("_s").over(W.partitionBy(*keys).orderBy("_r").rowsBetween(W.unboundedPreceding, -1))).drop("_s")
    inside = r.withColumn("_inside", F.sum("_n").over(W.partitionBy(*keys, "_r").orderBy(column).rowsBetween(W.unboundedPreceding, -1)))
    below = F.coalesce("_inside", F.lit(0)) + F.coalesce("_before", F.lit(0))
    return joined(inside, shift, [*keys, "_r"]).select(*keys, column, "_n", below.alias("_below"))


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's place, from 0, in an order of all rows, which should tell them apart.

    Rows are dealt out by ranges of the order and sorted within, in a table stored when this is
    called; places are those within a range, shifted by the rows of the ranges before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ranges = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    each = stored(sorted_ranges.select("*", F.spark_partition_id().alias("_p"), (F.monotonically_increasing_id() % (1 << 33)).alias("_k")))
    before = each.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    return each.join(F.broadcast(before), "_p").select(*df.columns, (F.col("_k") + F.col("_before")).alias(name))
