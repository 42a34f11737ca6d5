"""The queries over whole windows and sequences against brute force."""

import collections
import math

import pytest

from strandlake.plans import registry
from strandlake.plans import views as v


def test_every_position_is_extracted(spark, data):
    track = {(r.chrom, r.start): r.value for r in v.track(spark, data).collect()}
    want = {(w.id, i): track.get((w.chrom, i), 0) for w in registry.windows(spark, data).collect() for i in range(w.start, w.end)}
    assert {(r.id, r.pos): r.value for r in registry.QUERIES["dense_extraction_whole"](spark, data).collect()} == want


def test_every_letter_is_counted(spark, data):
    seqs = {r.id: r.seq for r in v.sequences(spark, data).collect()}
    assert max(map(len, seqs.values())) > 30
    rows = registry.QUERIES["one_hot_round_trip_whole"](spark, data).collect()
    assert {r.id: (r.back, r.n_a) for r in rows} == {i: (s, s.count("A")) for i, s in seqs.items()}
    want = collections.Counter((i, c) for s in seqs.values() for i, c in enumerate(s))
    assert {(r.pos, r.base): r.n for r in registry.QUERIES["position_counts_whole"](spark, data).collect()} == want

    def ic(counts):
        p = [(counts[b] / sum(counts.values()) + 0.001) / 1.004 for b in "ACGT"]
        return sum(x * math.log2(x / 0.25) for x in p)

    by = collections.defaultdict(collections.Counter)
    keyed = collections.defaultdict(collections.Counter)
    for i, s in seqs.items():
        for pos, c in enumerate(s):
            by[pos][c] += 1
            keyed[i % 20, pos][c] += 1
    got = {r.pos: r.ic for r in registry.QUERIES["information_content_whole"](spark, data).collect()}
    assert got == pytest.approx({k: ic(c) for k, c in by.items()}, abs=2e-6)
    rows = registry.QUERIES["trimmed_motifs_whole"](spark, data).collect()
    assert rows and all(r.ic == pytest.approx(ic(keyed[r.key, r.pos]), abs=2e-6) for r in rows) and max(r.pos for r in rows) >= 30


def test_cells_are_made_behind_the_join(spark, data):
    plan = registry.QUERIES["dense_extraction"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Generate posexplode") < plan.find("Join ")


def test_windows_keep_their_columns(spark, data):
    """Starts come with the windows, not by another join: one for loci within a chunk, one for those across, one each for bounds."""
    plan = registry.QUERIES["dense_extraction_whole"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 4
