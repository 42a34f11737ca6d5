"""op12 and op13: against plain numpy, and their odd rows."""

import numpy as np
import pytest

from strandlake.llm import queries, vectors, whitening

ODD = [(900, None), (901, []), (902, [0.0] * 5), (903, [float("nan")] * 5), (904, [1.0, None, 0.0, 0.0, 0.0]), (905, [float("inf"), 0.0, 0.0, 0.0, 0.0])]


def plain(ids, x):
    """vec_id: links, component, kept; ids are different."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], 1 << 60).min(axis=1))
        if (new == label).all():
            return {i: (int(k), int(c), i == c) for i, k, c in zip(ids, linked.sum(axis=1), label, strict=True)}
        label = new


def found(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def mates(n, dim, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    near = base + rng.standard_normal(base.shape) * 0.31 * rng.uniform(0.1, 1.2, (n, 1))
    x = np.concatenate([base, near, near[: n // 4], 3 * near[: n // 4]]) + shift
    return rng.permutation(len(x)).tolist(), x.astype(np.float32).astype(float)


@pytest.mark.parametrize(("dim", "shift"), [(32, 0.0), (16, 1.5), (3, 0.0), (2, 0.2), (1, 0.0)])
def test_all_links(spark, dim, shift):
    ids, x = mates(600 if dim > 3 else 150, dim, dim, shift)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, cell int")
    assert found(vectors.near_duplicates(df)) == plain(ids, x)


def test_many_cells_and_tiles(spark, monkeypatch):
    for name, value in (("CELL", 16), ("BLOCK", 8), ("ASKERS", 32)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(5)
    ids, x = mates(400, 24, 9)
    group = rng.standard_normal(24) + rng.standard_normal((200, 24)) * 0.1
    x, ids = np.concatenate([x, group]), [*ids, *range(5000, 5200)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    want = plain(ids, x)
    assert want[5000][0] == 199
    assert found(vectors.near_duplicates(df)) == want


def test_odd_vectors_link_with_nothing(spark):
    rows = [(3, [1.0, 0.0, 0.0, 0.0, 0.0]), (1, [2.0, 0.1, 0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (None, [5.0, 0.0, 0.0, 0.0, 0.0]), (4, [-1.0, 0.0, 0.0, 0.0, 0.0]), (1, [0.0, 0.0, 0.0, 0.0, 1e-300]), *ODD]
    got = sorted(map(tuple, vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    want = [(3, 2, 1, False), (1, 2, 1, True), (2, 0, 2, True), (None, 2, 1, False), (4, 0, 4, True), (1, 0, 1, True), *((i, 0, i, True) for i, _ in ODD)]
    assert got == sorted(want, key=str)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = vectors.Codes(48, 4, np.zeros(48))
    code, scale, error = codes.encoded(x[:1500])
    off = (codes.decoded(code, scale) * x[1500:]).sum(axis=1) - (x[:1500] * x[1500:]).sum(axis=1)
    assert abs(off.mean()) < 0.01 and (np.abs(off) <= error).mean() > 0.998 and error.mean() < 0.5
    # what isn't asked from one side is asked from the other
    p = x[:1500]
    q = p + rng.standard_normal(p.shape) * 0.3162 / np.sqrt(48)
    (a, ca), (b, cb) = codes.cells(p), codes.cells(q / np.linalg.norm(q, axis=1, keepdims=True))
    crossed = ((a ^ b)[:, None] >> np.arange(4)) & 1
    assert (np.minimum((crossed * ca).sum(axis=1), (crossed * cb).sum(axis=1)) <= codes.reach).mean() > 0.998


def test_vectors_query(spark, data):
    t = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    assert found(queries.queries()["op12_vectors"](spark, data)) == plain(t.vec_id.tolist(), np.stack(t.embedding).astype(float))


def white(x):
    f = np.unique(x, axis=0)
    n, s = len(f), f.sum(axis=0)
    v = (f - s / n).T @ (f - s / n) / n
    e, u = np.linalg.eigh(v)
    return n, s, e[::-1], u[:, ::-1], np.trace(v)


def check_white(got, ids, x):
    n, s, e, u, trace = white(x)
    k = min(4, x.shape[1])
    assert len(got) == k * len(x) and (got.n == n).all() and got.identity_error.max() < 1e-9
    away = dict(zip(ids, ((n * x - s) ** 2).sum(axis=1).tolist(), strict=True))
    assert all(away[i] == d for i, d in zip(got.vec_id, got.deviation, strict=True))
    for c in range(k):
        part = got[got.component == c + 1].set_index("vec_id").whitened.loc[ids].to_numpy()
        want = (x - s / n) @ u[:, c] / np.sqrt(e[c])
        assert min(np.abs(part - want).max(), np.abs(part + want).max()) < 1e-8
        assert np.allclose(got[got.component == c + 1].explained, e[c] / trace, rtol=1e-9)


@pytest.mark.parametrize(("dim", "falling"), [(40, True), (40, False), (3, False), (80, True)])
def test_whitening(spark, dim, falling):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((400, dim)) * (0.5 ** np.arange(dim) * 40 if falling else 1.0) + 2.5
    x = np.concatenate([x, x[:50]])
    ids = list(range(len(x)))
    df = spark.createDataFrame([*((i, v.tolist(), 1.0) for i, v in zip(ids, x, strict=True)), *((i, v, 1.0) for i, v in ODD)], "vec_id long, embedding array<double>, whitened double")
    check_white(whitening.whitened(df.filter("vec_id < 900")).toPandas(), ids, np.floor(256 * x))
    assert whitening.whitened(df).filter("vec_id >= 900").count() == 0


def test_narrow_range_and_full_dimension(spark, monkeypatch):
    widths = []
    plain_sum = whitening.summed
    monkeypatch.setattr(whitening, "summed", lambda fit, dim, width, f: (widths.append(width), plain_sum(fit, dim, width, f))[1])
    rng = np.random.default_rng(1)
    x = np.floor(rng.standard_normal((300, 30)) * 0.1 ** np.arange(30) * 1e6)
    for scale, full in ((x, False), (np.floor(rng.standard_normal((300, 30)) * 1000), True)):
        widths.clear()
        fit = spark.createDataFrame([(v.astype(int).tolist(),) for v in scale], "x array<long>")
        e, u = whitening.components(fit, len(scale), scale.mean(axis=0))
        _, _, want, vectors_, _ = white(scale)
        assert (30 in widths) == full and widths[0] == 12
        assert np.allclose(e, want[:4], rtol=1e-9) and np.allclose(np.abs((u * vectors_[:, :4]).sum(axis=0)), 1, atol=1e-12)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (5, [1.0])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(1, 0, None, None, None)] * 6
    huge = whitening.whitened(spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 0.0]), (3, [0.0, 1.0])], schema)).filter("component = 1").collect()
    assert {r["vec_id"]: r["deviation"] for r in huge} == {1: None, 2: None, 3: (3 * 256 - 256) ** 2}


def test_whitening_query(spark, data):
    t = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    check_white(queries.queries()["op13_whitening"](spark, data).toPandas(), t.vec_id.tolist(), np.floor(256 * np.stack(t.embedding).astype(float)))
