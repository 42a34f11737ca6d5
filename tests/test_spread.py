"""Sorted passes that no key turns into one task, against plain versions."""

import random

import numpy as np
import pandas as pd
import pytest

from strandlake.operators import intervals as iv
from strandlake.operators import motifs, stats

SIZES = [3, 40, 1 << 16]


def drawn(n, reach, longest, seed, fixed=None):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = r.randrange(reach)
        out.append((i, r.choice(["a", "a", "a", "b", None]), a, a + (fixed or r.randrange(longest + 1)), r.randrange(9)))
    return out


@pytest.mark.parametrize("size", SIZES)
def test_islands(spark, size):
    rows = [*drawn(120, 400, 9, 1), (500, "b", 50, 380, 3)]
    want = []
    for key in ("a", "b", None):
        part = sorted((a, b, i, s) for i, k, a, b, s in rows if k == key)
        for a, b, i, s in part:
            if want and want[-1][0] == key and a <= want[-1][2]:
                _, start, end, n, best = want.pop()
                want.append((key, start, max(end, b), n + 1, max(best, (s, -i))))
            else:
                want.append((key, a, b, 1, (s, -i)))
    df = spark.createDataFrame(rows, "id long, key string, start long, end long, score long")
    got = [(r.key, r.start, r.end, r.n, (r.best_score, -r.best_id)) for r in iv.merged(df, ["key"], size).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert iv.merged(df.limit(0), ["key"], size).count() == 0


@pytest.mark.parametrize("size", SIZES)
def test_resolved_pieces(spark, size):
    rows = drawn(90, 700, 0, 2, fixed=20)
    want = []
    for key in ("a", "b", None):
        part = sorted((a, i, b) for i, k, a, b, _ in rows if k == key)
        last = None
        for k, (a, i, b) in enumerate(part):
            end = b
            if k + 1 < len(part) and part[k + 1][0] < b:
                end = ((a + b) // 2 + (part[k + 1][0] + part[k + 1][2]) // 2) // 2
            start = a if last is None else max(a, last)
            last = end
            if end > start:
                want.append((i, start, end))
    df = spark.createDataFrame(rows, "id long, chrom string, start long, end long, score long")
    assert sorted((r.id, r.piece_start, r.piece_end) for r in iv.resolved(df, size).collect()) == sorted(want)


def test_nearest_of_each_key(spark):
    rows = [(i, "p" if i % 3 else "q", k or "c", a, b) for i, k, a, b, _ in drawn(60, 60, 12, 3)]
    want = {}
    for i, p, k, a, b in rows:
        for _, q, m, c, d in rows:
            if p == q and k != m and (d <= a or c >= b):
                x = (c + d) // 2 - (a + b) // 2
                want[i, k, m] = min(want.get((i, k, m), (1 << 30, 0)), (abs(x), x))
    df = spark.createDataFrame(rows, "id long, peak string, key string, start long, end long")
    assert {(r.id, r.key, r.key_b): r.distance for r in motifs.pair_distances(df).collect()} == {k: x for k, (_, x) in want.items()}


@pytest.fixture(scope="module")
def values(spark):
    r = np.random.default_rng(4)
    rows = [(i, k, float(x)) for i, (k, x) in enumerate(zip(r.choice(["a", "a", "a", "b"], 400), np.where(r.random(400) < 0.3, 0.01, r.random(400) ** 4).round(3), strict=True))]
    rows += [(1000, None, 0.001), (1001, None, 0.9), (1002, "c", 0.5)]
    return rows, spark.createDataFrame(rows, "id long, key string, x double")


def test_ranks(values):
    rows, df = values
    plain = pd.DataFrame(rows, columns=["id", "key", "x"]).fillna({"key": "-"})
    want = dict(zip(plain["id"], plain.groupby("key")["x"].rank(), strict=True))
    assert {r.id: r.rank for r in stats.spread_ranks(df, "x", ["key"], "rank").collect()} == want


def test_false_discovery(values):
    rows, df = values
    want = set()
    for key in ("a", "b", "c", None):
        part = sorted((x, i) for i, k, x in rows if k == key)
        cut = max((x for n, (x, _) in enumerate(part, 1) if x <= n / len(part) * 0.05), default=-1)
        want |= {i for x, i in part if x <= cut}
    assert {r.id for r in stats.benjamini_hochberg(df, "x", ["key"], 0.05).collect()} == want and want


def test_quantiles(spark, values):
    rows, df = values
    at = {"low": 0.003, "mid": 0.5, "high": 0.977, "most": 1.0}
    df = df.unionByName(spark.createDataFrame([(2000, "a", None)], df.schema))
    for r in stats.quantiles(df, "x", ["key"], at).collect():
        assert [r[n] for n in at] == pytest.approx(np.quantile([x for _, k, x in rows if k == r.key], list(at.values())))
    assert list(stats.quantiles(df, "x", [], at).first()) == pytest.approx(np.quantile([x for *_, x in rows], list(at.values())))
    assert list(stats.quantiles(df.limit(0), "x", [], at).first() or [None] * 4) == [None] * 4
