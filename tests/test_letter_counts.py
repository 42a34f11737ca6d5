"""Counts by position of texts longer than what is counted at a time."""

import numpy as np
import pyarrow as pa

from strandlake.operators import genome


def test_letters_are_counted_some_at_a_time(spark):
    texts = ["ACGT", None, "", "A" * 10, "CC"]
    parts = list(genome._parts(pa.array(texts), 4))
    assert [len(p[0]) for p in parts] == [4, 4, 4, 4]
    assert "".join(map(chr, np.concatenate([p[0] for p in parts]))) == "ACGT" + "A" * 10 + "CC"
    assert np.concatenate([p[1] for p in parts]).tolist() == [*range(4), *range(10), 0, 1] and np.concatenate([p[2] for p in parts]).tolist() == [0] * 4 + [3] * 10 + [4] * 2
    long = spark.createDataFrame([(k, "ACGT" * 40_000 + "A" * k) for k in (1, 2, 3, 3)], "k long, seq string")
    n = {(r.k, r.pos): (r.base, r.n) for r in genome.position_counts(long, ["k"]).collect()}
    assert len(n) == 480_006 and n[3, 160_002] == ("A", 2) and n[1, 159_999] == ("T", 1) and n[2, 0] == ("A", 1)
