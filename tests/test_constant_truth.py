"""Correlations that have no number."""

import math

import numpy as np

from strandlake.operators import predictions


def test_correlation_with_a_constant_truth(spark):
    x = spark.createDataFrame([(1, [2.0] * 5, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [0.0] * 5, [1.0, 2.0, 3.0, 4.0, 5.0]), (3, [1.0, 2.0, 3.0, 4.0, 5.0], [1.0, 2.0, 3.0, 4.0, 5.0])], "id long, truth array<double>, predicted array<double>")
    got = {r.id: (r.pearson, r.spearman) for r in predictions.metrics(x, constant=math.nan).collect()}
    assert all(map(math.isnan, got[1])) and got[2] == (0, 0) and np.allclose(got[3], 1)
    assert {r.id: r.pearson for r in predictions.metrics(x).collect()}[1] == 0
