"""Samples by borders of the draws: the same rows as sorting gives, without a sort of all rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from strandlake.operators import sampling
from strandlake.plans import registry


def drawn(ids, seed=1):
    return sorted(ids, key=lambda i: (int(hashlib.md5(f"{i}/{seed}".encode()).hexdigest()[:8], 16), i))


@pytest.mark.parametrize("n", [-1, 0, 1, 7, 499, 500, 501, 10_000])
def test_same_rows_as_sorting(spark, n):
    df = spark.range(500).withColumn("x", F.col("id") * 2)
    want = set(drawn(range(500))[: max(n, 0)])
    assert {r.id for r in sampling.sample(df, "id", n).collect()} == want
    lazy = spark.createDataFrame([(n,)], "n long")
    assert {(r.id, r.x) for r in sampling.sample(df, "id", lazy).collect()} == {(i, 2 * i) for i in want}


def test_equal_draws_are_ranked_by_key(spark, monkeypatch):
    monkeypatch.setattr(sampling, "draw", lambda key, seed: (F.col(key) % 3 * 70_000).cast("long"))
    df = spark.range(30)
    order = sorted(range(30), key=lambda i: (i % 3, i))
    for n in (1, 9, 10, 11, 25, 30, 31):
        assert {r.id for r in sampling.sample(df, "id", n).collect()} == set(order[:n])


def test_too_few_rows_fail_when_the_query_runs(spark):
    few = sampling.sample_ratio(spark.range(10), "id", spark.range(100), 0.5)
    with pytest.raises(Exception, match="fewer rows to draw from than 50"):
        few.collect()
    assert sampling.sample_ratio(spark.range(10), "id", spark.range(100), 0.1).count() == 10
    assert sampling.sample(spark.range(0), "id", 5).count() == 0


@pytest.mark.parametrize("rows", [0, 1, 2, 5, 63, 64, 191, 192, 193, 1000])
def test_planned_rows_are_those_of_the_plan(spark, rows):
    df = spark.range(rows)
    got = sampling.whole_batches(df, "id", 64, 3)
    if not rows:
        with pytest.raises(Exception, match="too few rows"):
            got.collect()
    else:
        assert {r.id for r in got.collect()} == set(drawn(range(rows))[: sampling.batch_plan(rows, 64, 3)[0]])


@pytest.mark.parametrize("name", ["rows_for_batches", "background_sample", "seeded_sample"])
def test_no_task_sorts_all_rows(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan


def test_samples_start_no_job_when_made(spark, data):
    spark.sparkContext.setJobGroup("made", "queries being made")
    try:
        for name in ("rows_for_batches", "background_sample", "seeded_sample"):
            registry.QUERIES[name](spark, data)
        ids = spark.sparkContext.statusTracker().getJobIdsForGroup("made")
        # reading a table's schema is a job of its own
        assert len(ids) <= 6
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
