"""Embedding whitening: principal components by a randomised range finder.

Components of x = floor(256 * c) are the unit eigenvectors of the covariance of the
different vectors. A range of KEPT + MORE random directions is turned by repeated power
passes, each one job over all centred rows, and made orthonormal between them; the
eigenvectors of the covariance within the range (Rayleigh-Ritz) give the components. What
the covariance leaves of each beyond its own multiple (the residual) must be at most CLOSE
of the gap to the next eigenvalues, as its angle to the true component is at most their
ratio. Where PASSES passes don't get there, which is so for vectors of even directions,
the range becomes the full dimension; then one pass gives the components to double precision.

Rows whose vector is null, empty or holds null or non-finite components are dropped, as
are vectors of another length than most have (the longer on a tie). Rows of equal vectors
are fitted once and returned each, null vec_ids too. Components without variance have null
whitened values; they stay out of identity_error, which is null if none is left. explained is
null if nothing varies. A deviation beyond 63 bits is null. Vectors of fewer places than
KEPT have as many components. An empty table gives no rows. Only vec_id and embedding are
read.

Scale. A pass returns a row for each place and direction from every task, added up by place:
for dimension d, d * 12 numbers, and d * d in the last one. The driver gets the sums alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

KEPT, MORE, PASSES, CLOSE, SEED, SCALE = 4, 8, 4, 1e-10, 11, 256
SLICE = 1 << 16  #: rows that are multiplied at once


def whole(rows: DataFrame, name: str = "x") -> DataFrame:
    """vec_id and x, of rows whose vector is right."""
    e = F.col("embedding").cast("array<double>")
    good = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = F.transform(e, lambda c: F.floor(c * SCALE).cast("long"))
    return rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(good, F.lit(False))).select("vec_id", x.alias(name))


def matrices(batches: Iterator, place: int, dim: int) -> Iterator[tuple]:
    """Batches with their column of arrays as matrices of longs."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part, part.column(place).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def summed(fit: DataFrame, dim: int, width: int, of_rows) -> np.ndarray:
    """The sum of of_rows(x), dim x width numbers, over all rows of fit; tasks' parts are added up place by place."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for _, x in matrices(batches, 0, dim):
            part = of_rows(x)
            total = part if total is None else total + part
        if total is not None:
            flat = pa.array(np.ascontiguousarray(total).ravel())
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * width), flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), values], names=["place", "v"])

    parts = fit.select("x").mapInArrow(run, "place long, v array<double>")
    rows = parts.groupBy("place").agg(*(F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(width))) if width <= 64 else parts.select("place", F.posexplode("v").alias("k", "x")).groupBy("place", "k").agg(F.sum("x").alias("x")).groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda r: r["x"]).alias("v"))
    out = np.zeros((dim, width))
    for r in rows.collect():  # a row a place
        out[r[0]] = r[1] if width > 64 else r[1:]
    return out


def ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors within an orthonormal basis, of which image is the covariance's; and their residuals."""
    small = basis.T @ image
    e, w = np.linalg.eigh((small + small.T) / 2)
    e, w = e[::-1], w[:, ::-1]
    return e, basis @ w, np.linalg.norm(image @ w - basis @ w * e, axis=0)


def components(fit: DataFrame, n: int, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eigenvalues and eigenvectors (as columns) of the covariance of fit (x)."""
    dim = len(mean)
    k = min(KEPT, dim)

    def image(basis: np.ndarray) -> np.ndarray:
        def of_rows(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ basis)

        return summed(fit, dim, basis.shape[1], of_rows) / n

    width = min(dim, KEPT + MORE)
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, width)))[0]
    for _ in range(PASSES):
        if width == dim:
            break
        turned = image(basis)
        e, u, left = ritz(basis, turned)
        gaps = np.diff(-e[: k + 1])
        near = np.minimum(gaps[:k], np.r_[np.inf, gaps[: k - 1]])
        if (left[:k] <= CLOSE * near).all():
            return e[:k], u[:, :k]
        basis = np.linalg.qr(turned)[0]
    basis = np.eye(dim)
    e, u, _ = ritz(basis, image(basis))
    return e[:k], u[:, :k]


def whitened(rows: DataFrame) -> DataFrame:
    """op13: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark, kind = rows.sparkSession, rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    clean = whole(rows)
    size = clean.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], schema)
    dim = size[0]
    clean = clean.filter(F.size("x") == dim)
    fit = stored(clean.select("x").distinct())
    by_place = fit.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()  # a row a place
    n, sums = by_place[0]["n"], [0] * dim
    for r in by_place:
        sums[r["k"]] = int(r["s"])
    mean = np.array([s / n for s in sums])
    variance = summed(fit, dim, 1, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None])[:, 0] / n
    trace = float(variance.sum())
    e, u = components(fit, n, mean)
    k = len(e)
    some = e > trace * 1e-13 * dim
    to = u / np.sqrt(np.where(some, e, 1.0))
    centre = summed(fit, dim, 1, lambda x: np.pad((((x - mean) @ to).sum(axis=0)), (0, dim - k))[:, None])[:k, 0] / n
    spread = summed(fit, dim, k, lambda x: np.pad(((x - mean) @ to - centre).T @ ((x - mean) @ to - centre), ((0, dim - k), (0, 0))))[:k] / n
    error = float(np.abs(spread - np.eye(k))[np.ix_(some, some)].max()) if some.any() else None
    shares = (e / trace).tolist() if trace > 0 else [None] * k

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        reach = (1 << 63) - 1
        for batch, x in matrices(batches, 1, dim):
            m = len(x)
            most = max(abs(int(v)) for v in (x.max(), x.min())) if m else 0
            if (n * most + max(map(abs, sums))) ** 2 * dim <= reach:
                away = ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                away = [v if v <= reach else None for v in (sum((n * a - b) ** 2 for a, b in zip(r, sums, strict=True)) for r in x.tolist())]
            values = (x - mean) @ to
            for i in range(k):
                column = [pa.array(np.full(m, v) if v is not None else [None] * m, t) for v, t in ((i + 1, pa.int32()), (n, pa.int64()))]
                white = pa.array(values[:, i]) if some[i] else pa.nulls(m, pa.float64())
                share, off = (pa.array([v] * m, pa.float64()) for v in (shares[i], error))
                yield pa.RecordBatch.from_arrays([batch.column(0), *column, pa.array(away, pa.int64()), white, share, off], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return clean.select("vec_id", "x").mapInArrow(run, schema)
