"""The chain from loci to metrics scores each locus once, and has no row a letter or place."""

import math
import re

import numpy as np
import pytest

from strandlake.operators import predictions, scoring, stats, tracks
from strandlake.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_chain_has_no_row_a_letter_and_scores_once(spark, data):
    text = plan(registry.QUERIES["scored_loci"](spark, data))
    assert text.count("MapInArrow run") == 1 and "Window" not in text and "PythonUDF" not in text
    assert not re.search(r"explode\((split|arrays_zip)", text)


def test_metrics_of_a_row_need_no_shuffle(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 7, np.round(rng.normal(size=n), 1).tolist(), np.round(rng.normal(size=n), 1).tolist()) for i, n in enumerate([2, 3, 50, 150] * 5)]
    rows += [(8, [1.0, 2.0, 2.0], [0.1] * 3), (9, [0.0] * 3, [1.0, 2.0, 3.0]), (10, None, [1.0])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, label long, truth array<double>, predicted array<double>")
    found = predictions.metrics(df, keys=("id", "label"))
    assert "Exchange" not in plan(found)
    long = df.selectExpr("id", "explode(arrays_zip(truth, predicted)) z").selectExpr("id", "z.truth as t", "z.predicted as p").filter("id < 20")
    want = {r.id: (r.a, r.spearman) for r in long.groupBy("id").agg(stats.correlation("t", "p").alias("a")).join(stats.spearman(long, "t", "p", ["id"]), "id").collect()}
    got = {r.id: (r.pearson, r.spearman) for r in found.collect()}
    assert len(got) == len(rows)
    for i, w in want.items():
        assert got[i] == pytest.approx(w, abs=1e-12)
    assert got[20] == got[21] == got[22] == (0, 0)


def test_truth_from_chunks_that_end_early(spark):
    """One table of chunks holds both strands; its last chunks are shorter, and windows go beyond them."""
    chunks = spark.createDataFrame([("c", 0, [1, 2, 3, 4], [0, 0, 5, 0]), ("c", 1, [7], [8]), ("d", 0, [], None)], "chrom string, chunk_id long, plus array<tinyint>, minus array<tinyint>")
    loci = spark.createDataFrame([(1, "c", 1, 3), (2, "c", 2, 7), (3, "c", 5, 8), (4, "d", 0, 2), (5, "e", 3, 5), (6, "c", 4, 4)], "id long, chrom string, start long, end long")
    got = {r.id: r.profiles for r in tracks.stacked(loci, [chunks], 4).collect()}
    assert got == {1: [[2, 3], [0, 5]], 2: [[3, 4, 7, 0, 0], [5, 0, 8, 0, 0]], 3: [[0] * 3] * 2, 4: [[0, 0]] * 2, 5: [[0, 0]] * 2, 6: [[], []]}
    letters = spark.createDataFrame([("c", 0, 0, "ACGTA")], "chrom string, chunk_id long, start long, seq string")

    def scorer(x):
        return x[:, :, :2] + 0.0, np.zeros((len(x), 1))

    out = {(r.id, r.strand): r for r in scoring.evaluated(loci.filter("id = 1"), letters, 10, [chunks], scorer, width=2).collect()}
    assert [list(out[1, k].truth) for k in (0, 1)] == [[2, 3], [0, 5]] and out[1, 1].true_log_count == pytest.approx(math.log(6))
