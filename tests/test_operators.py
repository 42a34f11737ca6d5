import collections
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import profile as pf
from strandlake.functions import sequence as sq
from strandlake.operators import intervals as iv
from strandlake.operators import motifs, sampling, stats
from strandlake.sources import files


def test_sequence_cases(spark):
    df = spark.createDataFrame([("ACGN",), ("AAGGTTCC",), ("CTCTGG",), ("NNNN",), ("CCCCAAA",), ("",)], "s string")
    got = [r[0] for r in df.select(sq.reverse_complement(F.col("s"))).collect()]
    assert got == ["NCGT", "GGAACCTT", "CCAGAG", "NNNN", "TTTGGGG", ""]
    hot = df.select(sq.one_hot(sq.fixed_length(F.col("s"), 4)).alias("h")).collect()[0].h
    assert hot == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]]
    assert df.select(sq.round_to_multiple(F.lit(500), 64), sq.round_to_multiple(F.lit(500), 64, True)).first()[:] == (448, 512)
    assert [r[0] for r in df.select(sq.gc_percent(F.col("s"))).collect()] == [50, 50, 67, 0, 57, None]


def test_overlap_join_against_brute_force(spark):
    rng = random.Random(4)
    make = lambda n: [(i, rng.choice("xy"), (s := rng.randrange(300)), s + rng.choice([0, 1, 3, 40, 90])) for i in range(n)]
    a, b = make(60), make(60)
    left = spark.createDataFrame(a, "id long, chrom string, start long, end long")
    right = spark.createDataFrame(b, "b_id long, chrom string, b_start long, b_end long")
    got = sorted((r.id, r.b_id) for r in iv.overlap_join(left, right, 16).select("id", "b_id").collect())
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert got == want
    rest = {r.id for r in iv.overlap_join(left, right, 16, how="left_anti").collect()}
    assert rest == {x[0] for x in a} - {i for i, _ in want}


@pytest.mark.parametrize(("mode", "kept"), [("ends", {1, 3}), ("overlap", {3})])
def test_blacklist_modes(spark, mode, kept):
    """A region strictly inside a peak is missed by the ends rule only."""
    peaks = spark.createDataFrame([(1, "x", 0, 100), (2, "x", 35, 60), (3, "x", 200, 300)], "id long, chrom string, start long, end long")
    regions = spark.createDataFrame([("x", 30, 40)], "chrom string, b_start long, b_end long")
    assert {r.id for r in iv.without_blacklisted(peaks, regions, 16, mode).collect()} == kept


def test_nearest_prefers_first_on_ties(spark):
    p = spark.createDataFrame([(1, "x", 10), (2, "x", 5000), (3, "y", 1)], "id long, chrom string, pos long")
    t = spark.createDataFrame([("x", 5), ("x", 15)], "chrom string, pos long")
    got = {r.id: r.distance for r in iv.nearest(p, t, 64).collect()}
    assert got == {1: -5, 2: -4985, 3: None}


def test_smoothing_and_likelihood(spark):
    assert len(pf.kernel(7.0, 81)) == 81
    x = [0.0, 0.0, 4.0, 0.0, 0.0, 1.0]
    df = spark.createDataFrame([(x, [1 / 6] * 6)], "a array<double>, p array<double>")
    got = df.select(pf.smoothed(1.0, 5)("a"), pf.multinomial_nll("a", "p"), pf.sum_fixed(F.array(F.lit(0.5), F.lit(0.6)))).first()
    k = pf.kernel(1.0, 5)
    assert np.allclose(got[0], np.convolve(np.pad(x, len(k) // 2, mode="symmetric"), k, "valid"))
    want = -(math.lgamma(6) - math.lgamma(5) - math.lgamma(2) + 5 * math.log(1 / 6)) / 6
    assert got[1] == pytest.approx(want)
    assert got[2] == pytest.approx([0.5, 0.5])


def test_shuffle_keeps_dinucleotides(spark):
    s = "ACGTTGCAACGGTTACCA" * 3
    t = spark.createDataFrame([(s, 5)], "s string, n long").select(pf.dinucleotide_shuffled("s", "n")).first()[0]
    count = lambda x: collections.Counter(zip(x, x[1:]))
    assert count(t) == count(s) and t[0] == s[0] and t[-1] == s[-1]


def test_matching_is_without_replacement(spark):
    p = spark.createDataFrame([(i, "c", 50) for i in range(5)], "id long, chrom string, gc long")
    c = spark.createDataFrame([(100 + i, "c", 50 + i % 3) for i in range(6)], "id long, chrom string, gc long")
    rows = sampling.matched_nearby(p, c, "chrom", "gc", 2).collect()
    assert len(rows) == 5 and len({r.positive_id for r in rows}) == 5 and len({r.candidate_id for r in rows}) == 5
    with pytest.raises(ValueError):
        sampling.sample_ratio(p, "id", 100, 0.5)


def test_ensemble_needs_all_members(spark):
    rows = [(c, m, i, 0.5, 0.0) for c, ms in ((1, (0, 1)), (2, (0,))) for m in ms for i in (0, 1)]
    got = motifs.ensemble_mean(spark.createDataFrame(rows, "coord long, member long, pos long, p double, log_total double"), 2).collect()
    assert {(r.coord, r.pos): round(r.value, 6) for r in got} == {(1, 0): 0.5, (1, 1): 0.5}


def test_scan_finds_both_strands(spark):
    pwm = {"m": np.where(np.eye(4)[[0, 0, 1]] > 0, 1.0, -5.0)}
    chunks = spark.createDataFrame([("x", 10, "TTAACGTTA")], "chrom string, start long, seq string")
    got = {(r.start, r.strand) for r in motifs.scan_pwm(chunks, pwm, 3.0).collect()}
    assert got == {(12, "+"), (15, "-")}


def test_scorer_runs_on_batches(spark):
    df = spark.createDataFrame([(1, "AC"), (2, "GGG")], "id long, seq string")
    got = {r.id: r.logits for r in motifs.scored(df, lambda seqs: [[float(len(x))] for x in seqs]).collect()}
    assert got == {1: [2.0], 2: [3.0]}


def test_files(spark, tmp_path):
    (tmp_path / "p.bed").write_text("chr1\t10\t20\t.\t1\t.\t5.5\t-1.0\t3.1\t4\n")
    peaks = files.read_narrow_peak(spark, str(tmp_path / "p.bed"))
    row = peaks.first()
    assert (row.chrom, row.name, row.signal, row.summit) == ("chr1", None, 5.5, 4)
    files.write_narrow_peak(peaks, str(tmp_path / "out"))
    assert files.read_narrow_peak(spark, str(tmp_path / "out")).collect() == [row]
    (tmp_path / "g.fa").write_text(">chr1 first\nACGT\nacgtA\n>chr2\nTT\n")
    got = {(r.chrom, r.start): r.seq for r in files.read_fasta(spark, str(tmp_path / "g.fa"), 4).collect()}
    assert got == {("chr1", 0): "ACGT", ("chr1", 4): "ACGT", ("chr1", 8): "A", ("chr2", 0): "TT"}
    m = spark.createDataFrame([("m1", 0, 0.1, 0.2, 0.3, 0.4), ("m1", 1, 0.25, 0.25, 0.25, 0.25)], "motif string, pos int, a double, c double, g double, t double")
    files.write_meme(m, str(tmp_path / "m.meme"))
    assert sorted(files.read_meme(spark, str(tmp_path / "m.meme")).collect()) == sorted(m.collect())
    (tmp_path / "s.csv").write_text("chr1:100-200,k.pfm,5,+,7.5,ACGT\nbroken\n")
    assert files.read_scan_csv(spark, str(tmp_path / "s.csv")).first()[:] == ("chr1", 105, 109, "k", "+", 7.5)
    (tmp_path / "t.json").write_text(json.dumps({"0": {"loci": {}}}))
    assert files.read_tasks(str(tmp_path / "t.json")) == {0: {"loci": {}}}
    assert files.with_defaults({"a": {"x": 1}}, {"a": {"x": 0, "y": 2}, "b": 3}) == {"a": {"x": 1, "y": 2}, "b": 3}


def test_trimming_keeps_all_where_none_passes(spark):
    rows = [("a", i, x) for i, x in enumerate([0.0, 0.1, 0.5, 0.1, 0.3, 0.0])] + [("b", 0, 0.1), ("b", 1, 0.0)]
    got = motifs.trimmed(spark.createDataFrame(rows, "key string, pos long, ic double"), 0.2, 1).collect()
    assert sorted((r.key, r.pos) for r in got) == [("a", i) for i in range(1, 6)] + [("b", 0), ("b", 1)]


def test_poisson_tails(spark):
    rows = [(0, 0.0), (0, 1.0), (2, 1.0), (1_000_000, 1e6), (2_000_000, 1e6)]
    p = [r.p for r in spark.createDataFrame(rows, "k long, m double").coalesce(1).select(motifs.poisson_greater("k", "m").alias("p")).collect()]
    assert p == pytest.approx([0, 1 - math.exp(-1), 1 - 2.5 * math.exp(-1), 0.5, 0], abs=1e-3)


def test_metric_bounds_of_odd_counts(spark):
    df = spark.createDataFrame([(1, [3.0, 1.0]), (2, [0.0, 0.0]), (3, []), (4, None)], "id long, a array<double>")
    best, worst = pf.metric_bounds(F.col("a"))["mnll"]
    got = {r.id: (r.x, r.y) for r in df.select("id", best.alias("x"), worst.alias("y")).collect()}
    assert got[2] == got[3] == got[4] == (0, 0)
    assert got[1] == pytest.approx((-math.log(4 * 0.75**3 * 0.25) / 2, -math.log(4 * 0.5**4) / 2))


def test_rates_stop_at_the_least(spark):
    rows = [(i, x) for i, x in enumerate([5.0, 4.0, 4.0, 4.0, 4.0, 4.0, 4.0, 1.0])]
    got = [r.rate for r in stats.plateau_rates(spark.createDataFrame(rows, "epoch long, loss double"), 2, 4e-4).orderBy("epoch").collect()]
    assert got == pytest.approx([4e-4, 4e-4, 4e-4, 2e-4, 1e-4, 1e-4, 1e-4, 1e-4])
