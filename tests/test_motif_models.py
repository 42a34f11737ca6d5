"""Score thresholds, similarity, the mixture and discovery, clusters and components against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import motifs
from strandlake.plans import registry


def test_thresholds_are_those_of_all_words():
    rng = np.random.default_rng(1)
    for p in (0.3, 0.05, 0.004):
        m = np.round(rng.normal(size=(5, 4)), 1)
        scores = np.array([sum(m[i, b] for i, b in enumerate(w)) for w in itertools.product(range(4), repeat=5)])
        t = motifs.score_threshold(m, p)
        assert (scores >= t - 1e-9).mean() < p + 1e-12 <= (scores >= scores[scores < t - 1e-9].max() - 1e-9).mean() + 1e-12


def test_similarity_finds_shifts_and_strands(spark):
    rng = np.random.default_rng(2)
    a = rng.dirichlet([0.4] * 4, 9)
    b = np.r_[rng.dirichlet([0.4] * 4, 2), a[:7]]
    rows = [(n, i, *map(float, r)) for n, m in (("a", a), ("b", b), ("c", a[::-1, ::-1])) for i, r in enumerate(m)]
    df = spark.createDataFrame(rows, "motif string, pos int, a double, c double, g double, t double")
    got = {(r.query, r.target): (r.correlation, r.offset, r.strand) for r in motifs.similarity(df, df).collect()}
    assert got["a", "a"] == (pytest.approx(1), 0, "+") and got["b", "a"] == (pytest.approx(1), 2, "+") and got["a", "c"] == (pytest.approx(1), 0, "-")

    def best(x, y):
        out = []
        for t in (y, y[::-1, ::-1]):
            for off in range(1 - len(t), len(x)):
                i = [(p, p - off) for p in range(len(x)) if 0 <= p - off < len(t)]
                if len(i) >= 5:
                    out.append(np.corrcoef(np.concatenate([x[p] for p, _ in i]), np.concatenate([t[r] for _, r in i]))[0, 1])
        return max(out)

    named = {"a": a, "b": b, "c": a[::-1, ::-1]}
    assert all(got[k][0] == pytest.approx(best(named[k[0]], named[k[1]])) for k in got) and len(got) == 9


def em(x, rounds=100, tolerance=1e-6):
    """The same EM with numpy."""
    w, rate, mu, sd, before = np.full(3, 1 / 3), 1 / x.mean(), np.array([1.0, 3.0]) * x.mean(), np.full(2, x.std()), -math.inf
    for _ in range(rounds):
        p = np.stack([w[0] * rate * np.exp(-rate * x), *(w[k + 1] / (sd[k] * math.sqrt(2 * math.pi)) * np.exp(-((x - mu[k]) ** 2) / 2 / sd[k] ** 2) for k in range(2))])
        like = np.log(p.sum(axis=0)).mean()
        if like - before < tolerance:
            break
        before, r = like, p / p.sum(axis=0)
        w, rate = r.mean(axis=1), r[0].sum() / (r[0] * x).sum()
        mu = (r[1:] * x).sum(axis=1) / r[1:].sum(axis=1)
        sd = np.sqrt((r[1:] * x * x).sum(axis=1) / r[1:].sum(axis=1) - mu**2)
    return w, rate, mu, sd


def test_mixture(spark):
    rng = np.random.default_rng(3)
    x = np.round(np.r_[rng.exponential(1, 600), rng.normal(6, 0.5, 200), rng.normal(12, 1, 200)].clip(0), 3)
    fit = motifs.score_mixture(spark.createDataFrame([(float(v),) for v in x], "x double"), "x")
    w, rate, mu, sd = em(x)
    assert [fit["weight"], fit["rate"], fit["mean_1"], fit["mean_2"], fit["sd_1"], fit["sd_2"]] == pytest.approx([w[0], rate, *mu, *sd], rel=1e-6)
    assert fit["weight"] == pytest.approx(0.6, abs=0.05) and fit["rate"] == pytest.approx(1, abs=0.2)


def test_discovery_keeps_what_stands_out(spark):
    rng = np.random.default_rng(4)
    x = [*rng.exponential(1, 900).tolist(), *(25 + rng.normal(0, 0.2, 30)).tolist(), math.nan, math.inf]
    hits = spark.createDataFrame(list(enumerate(map(float, x))), "id long, score double")
    kept = {r.id: r.p for r in motifs.hits_by_discovery(hits, "score").collect()}
    assert set(range(900, 930)) <= set(kept) and len(kept) < 60 and not {930, 931} & set(kept)


def plain_discovery(x, fdr=0.05, bins=200):
    """id: p of what passes; x: scores, all finite."""
    x = np.asarray(x)
    lo, hi = x.min(), x.max()
    width = (hi - lo) / bins
    cell = np.minimum(np.floor((x - lo) / width), bins - 1).astype(int)
    mode = lo + width * (np.bincount(cell).argmax() + 0.5)
    above = x[x >= mode] - mode
    w, rate, mu, sd = em(above)
    parts = np.stack([np.log(w[0] * rate) - rate * above, *(np.log(w[k + 1] / (sd[k] * math.sqrt(2 * math.pi))) - (above - mu[k]) ** 2 / 2 / sd[k] ** 2 for k in range(2))])
    own = above[(parts[0] >= parts[1]) & (parts[0] >= parts[2])]
    own = own[own >= 0]
    tight = max(-math.log(1 - k / 20) / q for k in range(1, 20) if (q := np.quantile(own, k / 20)) > 0)
    p = np.exp(-tight * np.minimum(hi, np.maximum(lo, x - mode)))
    order = np.sort(p)
    under = np.flatnonzero(order <= np.arange(1, len(p) + 1) / len(p) * fdr)
    return {i: v for i, v in enumerate(p) if len(under) and v <= order[under[-1]]}


def test_discovery_against_a_plain_version(spark):
    rng = np.random.default_rng(8)
    x = np.round(np.r_[rng.exponential(1, 800), rng.exponential(9, 60)], 3)
    hits = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, score double")
    want = plain_discovery(x)
    assert 10 < len(want) < 200
    assert {r.id: r.p for r in motifs.hits_by_discovery(hits, "score").collect()} == pytest.approx(want, rel=1e-4)


def test_discovered_hits_query(spark, data):
    from strandlake.plans import views as v

    score = {r.id: (r.score / 1000.0) ** 2 for r in v.hits(spark, data).select("id", "score").collect()}
    want = {list(score)[i]: p for i, p in plain_discovery(list(score.values())).items()}
    got = {r.id: r.p for r in registry.QUERIES["discovered_hits"](spark, data).collect()}
    assert len(got) > 20 and got == pytest.approx(want, rel=1e-3)


def test_mixture_of_few_and_no_values(spark):
    none = spark.createDataFrame([(None,)], "x double")
    assert motifs.fitted_mixture(none, "x").count() == 0
    same = motifs.score_mixture(spark.createDataFrame([(2.0,)] * 5, "x double"), "x")
    assert same["weight"] + same["weight_1"] + same["weight_2"] == pytest.approx(1)
    assert motifs.hits_by_discovery(spark.createDataFrame([(1, float("nan"))], "id long, score double"), "score").count() in (0, 1)


def test_clusters_and_components(spark, data):
    from strandlake.plans import views as v

    x = {r.id: np.array(r.a) for r in v.arrays(spark, data).select("id", "a").collect()}
    label = {r.id: r.cluster for r in registry.QUERIES["clustered_profiles"](spark, data).collect()}
    assert set(label) == set(x) and len(set(label.values())) == 8
    centre = {k: np.mean([x[i] for i in x if label[i] == k], axis=0) for k in set(label.values())}
    near = [min(centre, key=lambda k: ((x[i] - centre[k]) ** 2).sum()) == label[i] for i in x]
    spread = sum(((x[i] - centre[label[i]]) ** 2).sum() for i in x)
    assert np.mean(near) > 0.9 and spread < sum(((y - np.mean(list(x.values()), axis=0)) ** 2).sum() for y in x.values())
    a = np.stack([x[i] for i in sorted(x)])
    _, vectors = np.linalg.eigh(np.cov(a.T))
    want = a @ vectors[:, ::-1][:, :5]
    got = np.array([r.pc for r in sorted(registry.QUERIES["principal_components"](spark, data).collect(), key=lambda r: r.id)])
    assert np.allclose(np.abs(got), np.abs(want), atol=0.1)


def test_backgrounds(spark, data):
    rows = registry.QUERIES["shuffled_backgrounds"](spark, data).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    seqs = {r.id: r.seq for r in __import__("strandlake.plans.views", fromlist=["x"]).sequences(spark, data).collect()}
    count = lambda s: sorted(zip(s, s[1:], strict=False))
    assert all(len(v) == 2 and all(count(r.background) == count(seqs[i]) for r in v) for i, v in by.items())
    assert any(v[0].background != v[1].background for v in by.values())


def test_functions_of_scores(spark):
    from strandlake.functions import profile as pf

    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(pf.without_nan(F.col("x"))).collect()] == [0.0, 1.7976931348623157e308, -1.7976931348623157e308, 2.0, 0.0]
    assert [r[0] for r in df.select(pf.finite(F.col("x"))).collect()] == [False, False, False, True, False]
    p = [r[0] for r in df.select(pf.hit_p_value(F.col("x"), F.lit(1.0), F.lit(0.5), F.lit(0.0), F.lit(9.0))).collect()]
    assert p == [1.0, 1.0, 1.0, pytest.approx(math.exp(-0.5)), 1.0]
    with pytest.raises(ValueError):
        pf.count_loss("other", F.lit(1.0), F.lit(1.0))
    r = spark.createDataFrame([([0.5, 0.3, 0.3],)], "p array<double>").select(pf.sum_fixed("p").alias("p")).first().p
    assert r == pytest.approx([0.4, 0.3, 0.3])
