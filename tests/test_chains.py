"""Scorer chain, catalogue scans, peaks by motifs and the order of clusters, against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import clusters, genome, intervals, motifs, scoring
from strandlake.plans import registry

BASES = "ACGT"


def naive(seq, pwms, least):
    out = set()
    for key, m in pwms.items():
        for strand, w in (("+", m), ("-", m[::-1, ::-1])):
            for i in range(len(seq) - len(w) + 1):
                part = seq[i : i + len(w)]
                if set(part) <= set(BASES):
                    x = sum(w[j, BASES.index(c)] for j, c in enumerate(part))
                    if x >= least[key] - 1e-9:
                        out.add((i, i + len(w), key, strand, round(x, 9)))
    return out


@pytest.mark.parametrize("size", [5, 40, 1000])
def test_hits_across_borders_come_once(spark, size):
    rng = np.random.default_rng(size)
    pwms = {f"m{i}": np.round(rng.normal(size=(n, 4)), 2) for i, n in enumerate([1, 3, 6, 7, 12, 19])}
    seqs = {c: "".join(rng.choice(list("ACGTACGTACGTN"), n)) for c, n in (("a", 300), ("b", 4), ("c", 41))}
    chunks = spark.createDataFrame([(c, i // size, i, s[i : i + size]) for c, s in seqs.items() for i in range(0, len(s), size)] + [("d", 0, 0, None)], "chrom string, chunk_id long, start long, seq string")
    got = motifs.scan(chunks, pwms, size, p=0.02).collect()
    least = {k: motifs.score_threshold(m, 0.02) for k, m in pwms.items()}
    want = {(c, *h) for c, s in seqs.items() for h in naive(s, pwms, least)}
    assert len(want) > 20 and len(got) == len(want)
    assert {(r.chrom, r.start, r.end, r.key, r.strand, round(r.score, 9)) for r in got} == want


def test_thresholds_follow_the_background():
    rng = np.random.default_rng(1)
    m, q = np.round(rng.normal(size=(5, 4)), 1), np.array([0.4, 0.1, 0.1, 0.4])
    words = list(itertools.product(range(4), repeat=5))
    scores = np.array([sum(m[i, b] for i, b in enumerate(w)) for w in words])
    chance = np.array([np.prod(q[list(w)]) for w in words])
    for p in (0.2, 0.01):
        t = motifs.score_threshold(m, p, background=tuple(q))
        assert chance[scores >= t - 1e-9].sum() < p <= chance[scores >= scores[scores < t - 1e-9].max() - 1e-9].sum() + 1e-12


def test_too_many_matrices_are_an_error():
    with pytest.raises(ValueError, match="too many"):
        motifs.Stack({str(i): np.zeros((3000, 4)) for i in range(600)}, {str(i): 1.0 for i in range(600)})


@pytest.mark.parametrize("k", [1, 2, 3, 5, 7, 8])
def test_leaf_order_is_the_best_the_tree_allows(k):
    rng = np.random.default_rng(k)
    for _ in range(3):
        x = rng.normal(size=(k, 4))
        merges = clusters.linkage(x)

        def orders(node, merges=merges):
            if node < k:
                return [[node]]
            a, b = merges[node - k]
            return [p for u in orders(a) for w in orders(b) for p in (u + w, w + u)]

        def cost(o, x=x):
            return sum(math.dist(x[i], x[j]) for i, j in itertools.pairwise(o))

        every = orders(k + len(merges) - 1 if merges else 0)
        assert len(every) == 2 ** (k - 1)
        found = clusters.cluster_order(x)
        assert sorted(found) == list(range(k)) and cost(found) == pytest.approx(min(map(cost, every)))
        assert found == min((o for o in every if cost(o) < min(map(cost, every)) + 1e-9))


def test_linkage_merges_the_nearest_centroids():
    x = np.array([[0.0], [1.0], [10.0], [12.0], [5.2]])
    assert clusters.linkage(x) == [(0, 1), (2, 3), (4, 5), (6, 7)]
    assert clusters.cluster_order(x) in ([0, 1, 4, 2, 3], [3, 2, 4, 1, 0])


def test_peaks_by_motifs(spark):
    hits = spark.createDataFrame([("p", "x"), ("p", "x"), ("p", "y"), ("q", "z"), (None, "x"), ("r", None)], "peak string, key string")
    peaks = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3), ("s", 4)], "peak string, n int")
    m = clusters.motif_matrix(hits, peaks, ["x", "y", "other"])
    assert {r.peak: r.counts.toArray().tolist() for r in m.collect()} == {"p": [2, 1, 0], "q": [0, 0, 0], "r": [0, 0, 0], "s": [0, 0, 0]}
    assert type(m.filter("peak = 'p'").first().counts).__name__ == "SparseVector"
    assert sorted(map(tuple, clusters.cells(m, ["x", "y", "other"]).collect())) == [("p", "x", 2), ("p", "y", 1)]
    assert clusters.motif_names(hits) == ["x", "y", "z"]
    assert clusters.motif_matrix(hits, peaks, []).count() == 4


def test_clusters_lie_in_order(spark):
    rng = random.Random(1)
    rows = [(i, [float(c + rng.random()), float(rng.random())]) for i, c in enumerate([0, 50, 10, 52, 11, 1, 30] * 10)]
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame(rows, "id long, a array<double>").withColumn("f", array_to_vector("a"))
    out = clusters.clustered(df, "f", 4).collect()
    assert {r.place for r in out} == {0, 1, 2, 3} and len({(r.cluster, r.place) for r in out}) == 4
    middle = [np.mean([r.a[0] for r in out if r.place == p]) for p in range(4)]
    assert middle in (sorted(middle), sorted(middle, reverse=True))
    same = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "id long, a array<double>").withColumn("f", array_to_vector("a"))
    assert {(r.cluster, r.place) for r in clusters.clustered(same, "f", 4).collect()} == {(0, 0)}


def test_ordered_peaks(spark, data):
    rows = registry.QUERIES["ordered_peaks"](spark, data).collect()
    assert [(r.place, r.peak) for r in rows] == sorted((r.place, r.peak) for r in rows)
    assert {r.place for r in rows} == set(range(len({r.cluster for r in rows})))


def test_any_scorer(spark):
    """A scorer that isn't symmetrical: predictions from a plain loop over loci."""
    rng = np.random.default_rng(3)
    w, u = rng.normal(size=(10, 4, 2)), rng.normal(size=(10, 4)) / 9
    seqs = ["ACGTACGTAC", "NNNNNNNNNN", "GGGTTTACGN", "TT", None]

    def scorer(x):
        return x[:, :, :] @ np.ones((4, 2)) * 0 + np.einsum("nlb,lbs->nls", x, w), np.einsum("nlb,lb->n", x, u)[:, None]

    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    got = {(r.id, r.strand): r for r in scoring.predicted(df, scorer, 10, rows=2, window=6).collect()}
    one = {(r.id, r.strand): r for r in scoring.predicted(df, lambda x: (scorer(x)[0], np.repeat(scorer(x)[1], 2, axis=1)), 10, average=False).collect()}
    for i, s in enumerate(seqs):
        x = np.zeros((10, 4))
        for k, c in enumerate(s or ""):
            if c in BASES:
                x[k, BASES.index(c)] = 1
        f, g = np.einsum("lb,lbs->ls", x, w), np.einsum("lb,lbs->ls", x[::-1, ::-1], w)
        logits = (f + g[::-1, ::-1]) / 2
        n = (np.sum(x * u) + np.sum(x[::-1, ::-1] * u)) / 2
        p = np.exp(logits) / np.exp(logits).sum() * np.exp(n)
        for strand in (0, 1):
            assert got[i, strand].predicted == pytest.approx(p[2:8, strand].tolist())
            assert got[i, strand].predicted_log_count == pytest.approx(np.log(p[:, strand].sum()))
            alone = np.exp(f[:, strand]) / np.exp(f[:, strand]).sum() * np.exp(np.sum(x * u))
            assert one[i, strand].predicted == pytest.approx(alone.tolist()) and one[i, strand].predicted_log_count == pytest.approx(np.sum(x * u))
    assert scoring.predicted(df.limit(0), scorer, 10).count() == 0


def test_unknown_letters_are_an_error():
    assert scoring.tensor(["acgtNRyk"], 8, strict=True).sum() == 4
    with pytest.raises(ValueError, match="no bases: JX"):
        scoring.tensor(["ACXJ"], 4, strict=True)


def test_the_chain_takes_coordinates_once_and_cuts_windows(spark):
    chunks = spark.createDataFrame([("c", i, i * 10, "ACGTTGCAAC") for i in range(5)], "chrom string, chunk_id long, start long, seq string")
    loci = spark.createDataFrame([(7, "c", 10, 20), (3, "c", 10, 20), (5, "c", 22, 32)], "id long, chrom string, start long, end long")
    plus = spark.createDataFrame([("c", 12, 18, 2.0)], "chrom string, start long, end long, value double")
    minus = spark.createDataFrame([("c", 0, 50, 1.0)], "chrom string, start long, end long, value double")

    def scorer(x):
        return np.repeat(x[:, 2:-2, :2], 1, axis=1), np.zeros((len(x), 1))

    out = {(r.id, r.strand): r for r in scoring.evaluated(loci, chunks, 10, [plus, minus], scorer, flank=2, width=14, window=4).collect()}
    assert set(out) == {(3, 0), (3, 1), (5, 0), (5, 1)}
    assert list(out[3, 0].truth) == [2.0] * 4 and out[3, 0].true_log_count == pytest.approx(math.log(13)) and len(out[3, 0].predicted) == 4
    assert out[5, 0].mse == 0 and out[5, 0].jsd == 0 and out[3, 1].mse > 0


def test_unknown_chromosomes_fail_fast(spark):
    w = spark.createDataFrame([(1, "c", 0, 5), (2, "d", 0, 5)], "id long, chrom string, start long, end long")
    sizes = spark.createDataFrame([("c", 9)], "chrom string, size long")
    assert intervals.in_bounds(w, sizes).count() == 1
    with pytest.raises(Exception, match="unknown chromosome: d"):
        intervals.in_bounds(w, sizes, strict=True).collect()
    assert intervals.in_bounds(w.filter("id = 1"), sizes, strict=True).count() == 1


def test_counts_by_position(spark):
    df = spark.createDataFrame([(1, "AAC"), (1, "AG"), (2, ""), (2, None), (3, "N")], "k long, seq string")
    assert {(r.k, r.pos, r.base): r.n for r in genome.position_counts(df, ["k"]).collect()} == {(1, 0, "A"): 2, (1, 1, "A"): 1, (1, 1, "G"): 1, (1, 2, "C"): 1, (3, 0, "N"): 1}
    p = {(r.k, r.pos): (r.A, r.C, r.G, r["T"]) for r in genome.base_shares(genome.position_counts(df, ["k"]), ["k"]).collect()}
    assert p[1, 0] == (1, 0, 0, 0) and p[1, 1] == (0.5, 0, 0.5, 0) and p[3, 0] == (0, 0, 0, 0)
    assert genome.position_counts(df.limit(0), []).count() == 0
    back = {r.seq: r.back for r in scoring.through_tensors(df.withColumn("id", F.col("seq"))).withColumnRenamed("id", "seq").collect()}
    assert back["AAC"] == "AAC" and back["N"] == "N" and back[None] == ""
