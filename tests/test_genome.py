"""Base counts of windows, and matching in groups of any size."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import genome, sampling


@pytest.mark.parametrize(("width", "stride", "size"), [(7, 3, 5), (4, 4, 100), (30, 50, 8), (1, 1, 3), (12, 5, 12)])
def test_bins_count_their_letters(spark, width, stride, size):
    rng = random.Random(width)
    seqs = {c: "".join(rng.choice("ACGTNgc") for _ in range(n)) for c, n in (("a", 61), ("b", 1), ("c", 100))}
    chunks = spark.createDataFrame([(c, i // size, i, s[i : i + size]) for c, s in seqs.items() for i in range(0, len(s), size)] + [("c", 99, 10_000, None)], "chrom string, chunk_id long, start long, seq string")
    sizes = spark.createDataFrame([(c, len(s)) for c, s in seqs.items()] + [("none", 10), ("zero", 0)], "chrom string, size long")
    got = {(r.chrom, r.start): (r.end, r.n, r.gc) for r in genome.gc_bins(chunks, sizes, width, stride).collect()}
    want = {}
    for c, s in {**seqs, "none": "N" * 10}.items():
        for a in range(0, len(s), stride):
            n = sum(x in "GCgc" for x in s[a : a + width])
            want[c, a] = (a + width, n, (200 * n + width) // (2 * width))
    assert got == want
    loci = spark.createDataFrame([(i, "a", a, a + 9) for i, a in enumerate(range(-3, 70, 5))] + [(99, "none", 0, 4)], "id long, chrom string, start long, end long")
    counts = {r.id: r.n for r in genome.base_counts(loci, chunks, size).collect()}
    assert counts == {**{i: sum(x in "GCgc" for x in seqs["a"][max(a, 0) : max(a + 9, 0)]) for i, a in enumerate(range(-3, 70, 5))}, 99: 0}


def test_ranks_run_on_over_ranges(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "x").alias("g"))
    got = sampling.ranked(df, ["g"], "k", 3, ranges=5).collect()
    key = {r.id: r.d for r in df.select("id", sampling.draw("id", 3).alias("d")).collect()}
    for g in ("x", None):
        ids = sorted((i for i in range(1000) if (i % 10 == 0) == (g == "x")), key=lambda i: (key[i], i))
        assert {r.id: r.k for r in got if r.g == g} == {i: k for k, i in enumerate(ids)}


def test_no_task_holds_a_values_rows(spark):
    """All rows of one value: windows run over (group, value, range of the draw), joins over ranks."""
    one = spark.range(20_000).select("id", F.lit("c").alias("chrom"), F.lit(50).cast("long").alias("gc"))
    sizes = sampling.ranked(one, ["chrom", "gc"], "k").groupBy(F.shiftright(sampling.draw("id", 1), 20)).count().agg(F.max("count")).first()[0]
    assert sizes < 30
    out = sampling.matched_nearby(one, one, "chrom", "gc")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 20_000
    import re

    windows = [w for w in re.findall(r"Window \[row_number.*", plan)]
    assert windows and all("_r#" in w.split("], [")[1] for w in windows)


@pytest.mark.parametrize("drawn", [False, True])
def test_bounced_steps(spark, drawn):
    p = spark.createDataFrame([(1, "c", 2), (2, "c", 2), (3, "c", 0), (4, "c", 99)], "id long, chrom string, gc long")
    c = spark.createDataFrame([(11, "c", 0), (12, "c", 0), (13, "c", 100), (14, "c", 6), (15, "c", 90)], "id long, chrom string, gc long")
    got = {r.positive_id: (r.gc, r.step) for r in sampling.matched_nearby(p, c, "chrom", "gc", bounds=(1, 99), drawn=drawn).collect()}
    # those at 0 and 100 serve their own value alone
    assert got[3] == (0, 0) and all(gc in (6, 90) for i, (gc, _) in got.items() if i != 3) and len(got) == 3
    free = {r.positive_id: r.gc for r in sampling.matched_nearby(p, c, "chrom", "gc", drawn=drawn).collect()}
    assert len(free) == 4 and free[3] == 0 and free[4] == 100
