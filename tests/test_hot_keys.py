"""Joins and ranks in which most rows share a key or a value, and what is left behind."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import keys, stats
from strandlake.plans import registry


def largest_tasks(df):
    """Rows that the tasks of the last stage's partitions hold."""
    return max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle, not coalesced, so that a hot key would show."""
    new = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_a_hot_key_is_dealt_out(spark, shuffled):
    a = spark.range(0, 16_000, 1, 8).select("id", F.when(F.col("id") % 100 == 0, F.col("id")).when(F.col("id") % 100 != 1, 0).alias("k"))
    b = a.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    out = keys.frequency_joined(a, b, ["k"], "n")
    assert out.columns == ["id", "k", "most"]
    want = {r.id: r.most for r in keys.joined(a, b.drop("n"), ["k"]).collect()}
    assert {r.id: r.most for r in out.collect()} == want and len(want) == 16_000
    assert largest_tasks(out) < 4_000 < largest_tasks(keys.joined(a, b.drop("n"), ["k"]))


def test_keys_without_a_row_go(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id long, k string")
    b = spark.createDataFrame([("x", 5, None), (None, 1, 7)], "k string, n long, v long")
    assert sorted(map(tuple, keys.frequency_joined(a, b, ["k"], "n").collect())) == [(1, "x", None), (2, None, 7)]


def test_ranks_of_a_track_of_zeros(spark, shuffled):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(20_000) < 0.99, 0.0, np.round(rng.random(20_000), 2))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double").repartition(8).withColumn("t", F.lit("a"))
    out = stats.spread_ranks(df, "x", ["t"], "rank")
    rank = {r.id: r["rank"] for r in out.collect()}
    order = np.argsort(x, kind="stable")
    want, s = np.empty(len(x)), np.sort(x)
    for v in np.unique(x):
        a, b = np.searchsorted(s, v), np.searchsorted(s, v, "right")
        want[x == v] = (a + 1 + b) / 2
    assert len(order) == len(rank) and all(rank[i] == want[i] for i in range(len(x)))
    assert largest_tasks(out) < 6_000


@pytest.mark.parametrize("name", ["outlier_filter", "false_discovery", "track_statistics", "track_correlations", "discovered_hits"])
def test_nothing_stays_cached(spark, data, name):
    spark.catalog.clearCache()
    registry.QUERIES[name](spark, data).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_query_is_empty(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.01").limit(1).count() == 1


def test_places_in_an_order(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[int(x > 0.3)], int(y)) for i, (x, y) in enumerate(zip(rng.random(500), rng.integers(0, 5, 500), strict=True))]
    df = spark.createDataFrame(rows, "id long, c string, v long")
    got = {r.id: r.place for r in keys.placed(df, [F.col("v").desc(), F.col("c").asc(), F.col("id").asc()], "place").collect()}
    assert got == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[1], r[0])))}
    assert keys.placed(df.limit(0), [F.col("id")], "place").count() == 0
