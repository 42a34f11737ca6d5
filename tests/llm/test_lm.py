"""Scores against a plain backoff model, and the counts behind them."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import lm


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    some = [" ".join(f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    return [None, "", "  ", "One", "one ONE one", some[0], some[0], "x" * 50_000, "long word " * 20_000, "é Ü \n é", *some]


def plain(texts):
    """doc_id -> held_out, n_tokens, n_known, N, base_score, score; a walk over states with explicit failure arcs."""
    w = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in w}
    count = collections.Counter()
    for i, v in w.items():
        if not held[i]:
            v = [None, *v]
            for j in range(1, len(v)):
                count.update([(v[j],), (v[j - 1], v[j]), *([(v[j - 2], v[j - 1], v[j])] if j > 1 else [])])
    n, size = sum(c for k, c in count.items() if len(k) == 1), sum(len(k) == 1 for k in count)
    out = {}
    for i, v in w.items():
        state, base, score, known = (None,), 0.0, 0.0, 0
        for x in v:
            alone = (count[x,] + 1) / (n + size + 1)
            p, at, through = 0.0, state, 1.0
            while at:  # failure arcs to shorter histories
                seen, mu = count[at], lm.MU[len(at) - 1]
                p += through * count[(*at, x)] / (seen + mu)
                through *= mu / (seen + mu)
                at = at[1:]
            score += math.log10(p + through * alone)
            base += math.log10(alone)
            known += count[x,] > 0
            state = (*state, x)[-2:]
            while state and not count[state]:
                state = state[1:]
        out[i] = (held[i], len(v), known, n, pytest.approx(base, rel=1e-12), pytest.approx(score, rel=1e-12))
    return out


def rows(df):
    return {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()}


def test_scores_are_the_automatons(spark, texts, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for c in ("n", "words", "kind", "a.b"):
        df = df.withColumn(c, F.lit("x"))
    want = plain(texts)
    assert rows(lm.digest(df)) == want
    monkeypatch.setattr(lm, "HELD", 300)  # many chunks and merges, more ranges
    monkeypatch.setattr(lm, "RANGES", (128, 128))
    assert rows(lm.digest(df)) == want


def test_nulls_repeats_and_nothing_to_learn(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, None)], "doc_id long, text string")
    out = [tuple(r) for r in lm.digest(df).collect()]
    assert len(out) == 3 and len({r[2:] for r in out if r[0] is None}) == 1
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lm.digest(spark.createDataFrame([(held, "a b c")], "doc_id long, text string")).collect()
    assert (r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0)
    assert lm.digest(df.limit(0)).count() == 0


def test_counts_survive_merging():
    """Many small merges and counts beyond 32 bits give the same sums."""
    assert [lm.ranges_for(x) for x in (0, 500_000_000, 30 * 10**9, 10**14)] == [16, 64, 4096, 1 << 24]
    rng = np.random.default_rng(4)
    merger, want, held = lm.Merger(), collections.Counter(), lm.HELD
    lm.HELD = 50
    for _ in range(40):
        keys, counts = lm.tally(rng.integers(0, 300, 30).astype(np.uint64), np.full(30, 2**30))
        want.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        merger.add(keys, lm.unpacked(lm.packed(counts), len(keys)))
    lm.HELD = held
    keys, counts = merger.total()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want and max(want.values()) > 2**32
    for top in (0, 255, 256, 2**16, 2**32):
        assert lm.unpacked(lm.packed(np.array([1, top])), 2).tolist() == [1, top]


def test_probabilities_sum_to_one():
    """After any history, over the known words and one unknown."""
    rng = np.random.default_rng(2)
    words = rng.integers(0, 9, 400)
    c1, c2, c3 = (collections.Counter(zip(*(words[i : len(words) - k + i + 1] for i in range(k)), strict=True)) for k in (1, 2, 3))
    known = sorted({int(w) for w in words})
    n, v = sum(c1.values()) - 1, len(known)
    after = {h: c for h, c in c2.items() if h != tuple(words[-2:])}  # the last pair has no word after it
    for u, w in list(after)[:8]:
        ones = {x: c for (x,), c in c1.items()}
        ones[int(words[-1])] -= 1
        total = 0.0
        for x in [*known, 99]:
            counts = [np.array(a) for a in ([ones[u], ones[w], ones.get(x, 0)], [0, c2[u, w], c2[w, x]], [0, 0, c3[u, w, x]])]
            counts[0][1] = sum(c2[w, y] for y in known)
            total += lm.traversed(tuple(counts), 0, np.array([0]), n, v)[1][2]
        assert total == pytest.approx(1, abs=1e-9)


def test_keys_survive_squeezing():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 300, 5000):
        keys = np.unique(np.r_[rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2), np.array([0, 2**64 - 1] if n > 1 else [], np.uint64)])
        assert (lm.unsqueezed(lm.squeezed(keys)) == keys).all()
        assert n < 5000 or len(lm.squeezed(keys)) < 6.9 * n


def test_no_table_stays_in_the_catalogue(spark, data):
    from strandlake.llm import queries

    before = {t.name for t in spark.catalog.listTables()}
    df = queries.queries()["op10_lm"](spark, data)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert df.count() == spark.read.parquet(f"{data}/documents.parquet").count()
