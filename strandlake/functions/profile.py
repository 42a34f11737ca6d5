"""Column functions and Arrow UDFs on profiles: arrays of counts or probabilities by position."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once a row, not once for each element that body looks at."""
    return F.transform(F.array(value), body)[0]


def shares(a: Column) -> Column:
    """a over its sum; a zero sum divides by 1."""
    return let(F.struct(a.alias("a"), F.coalesce(F.nullif(total(a), F.lit(0.0)), F.lit(1.0)).alias("s")), lambda r: F.transform(r["a"], lambda x: x / r["s"]))


def softmax(a: Column) -> Column:
    return shares(let(F.struct(a.alias("a"), F.array_max(a).alias("top")), lambda r: F.transform(r["a"], lambda x: F.exp(x - r["top"]))))


def cross_entropy(counts: Column, probs: Column) -> Column:
    return -total(F.zip_with(shares(counts), probs, lambda t, p: t * F.log(p + 1e-7)))


def mean_square(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's, of two arrays; 0 where either is constant."""
    def centred(x: Column) -> Column:
        return let(F.struct(x.alias("a"), (total(x) / F.nullif(F.size(x), F.lit(0))).alias("m")), lambda r: F.transform(r["a"], lambda v: v - r["m"]))

    def spread(x: Column) -> Column:
        return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))

    def found(r: Column) -> Column:
        return total(F.zip_with(r["a"], r["b"], lambda x, y: x * y)) / F.nullif(spread(r["a"]) * spread(r["b"]), F.lit(0.0))

    return F.coalesce(let(F.struct(centred(a).alias("a"), centred(b).alias("b")), found), F.lit(0.0))


def jensen_shannon(a: Column, b: Column) -> Column:
    """Distance, natural logarithm, of the arrays as distributions."""
    def part(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log(q / m)).otherwise(0.0)

    return F.sqrt(F.greatest(total(F.zip_with(shares(a), shares(b), part)) / 2, F.lit(0.0)))


def uniform(a: Column) -> Column:
    """Equal shares over as many positions."""
    return F.transform(a, lambda x: F.lit(1.0) / F.size(a))


def metric_bounds(a: Column) -> dict[str, tuple[Column, Column]]:
    """The best and worst value of each profile metric: the counts against their own shares and against equal shares. Null, empty and all-zero counts have likelihood bounds of 0."""
    some = F.coalesce(total(a), F.lit(0.0)) > 0
    nll = tuple(F.when(some, F.coalesce(multinomial_nll_of_weights(a, b), F.lit(0.0))).otherwise(0.0) for b in (a, uniform(a)))
    return {"mnll": nll, "cross_entropy": (cross_entropy(a, shares(a)), cross_entropy(a, uniform(a))), "jsd": (F.lit(0.0), jensen_shannon(a, uniform(a)))}


def flipped(a: Column) -> Column:
    return F.reverse(a)


def min_max_normalised(x: Column, best: Column, worst: Column, default: float = 0.0) -> Column:
    """Best is 1, worst is 0, clamped; default where the bounds are equal."""
    return F.when(best == worst, default).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - worst) / F.nullif(best - worst, F.lit(0.0)))))


def kernel(sigma: float, width: int) -> np.ndarray:
    """Gaussian weights whose radius follows from the width of the moving window."""
    radius = int((((width - 1) / 2) - 0.5) / sigma * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


def smoothed(sigma: float = 7.0, width: int = 81):
    """An Arrow UDF: the array smoothed by a Gaussian, edges reflected."""
    weights = kernel(sigma, width)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(a: pd.Series) -> pd.Series:
        r = len(weights) // 2
        return a.map(lambda x: None if x is None else np.convolve(np.pad(np.asarray(x, float), r, mode="symmetric"), weights, "valid") if len(x) else np.empty(0))

    return run


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def ranks(a: pd.Series) -> pd.Series:
    """Average ranks of an array's values."""
    def one(x: np.ndarray | None) -> np.ndarray | None:
        if x is None:
            return None
        _, place, n = np.unique(np.asarray(x, float), return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2)[place]

    return a.map(one)


def _nll(k: np.ndarray | None, p: np.ndarray | None) -> float | None:
    if k is None or p is None or not len(k):
        return None
    k, p = np.asarray(k, float), np.asarray(p, float)
    if abs(p.sum() - 1) > 1e-3:
        raise ValueError("probabilities must sum to 1")
    pmf = math.lgamma(k.sum() + 1) - sum(map(math.lgamma, k + 1)) + float(np.where(k > 0, k * np.log(np.maximum(p, 1e-300)), 0).sum())
    return -pmf / len(k)


@F.pandas_udf(T.DoubleType())
def multinomial_nll(counts: pd.Series, probs: pd.Series) -> pd.Series:
    """Negative log-likelihood of counts under probabilities, by position: -log pmf / length; null for null or empty arrays."""
    return pd.Series([_nll(k, p) for k, p in zip(counts, probs, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def multinomial_nll_of_weights(counts: pd.Series, weights: pd.Series) -> pd.Series:
    """The same under weights, which are made to sum to 1; null also where they sum to 0."""
    shares = (None if w is None or not np.sum(w) > 0 else np.asarray(w, float) / np.sum(w) for w in weights)
    return pd.Series([_nll(k, p) for k, p in zip(counts, shares, strict=True)], dtype=float)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def sum_fixed(probs: pd.Series) -> pd.Series:
    """Probabilities whose sum is made 1: an excess comes off the largest, a deficit goes to the smallest."""
    def one(p: np.ndarray) -> np.ndarray:
        p = np.array(p, float)
        d = p.sum() - 1
        p[p.argmax() if d > 0 else p.argmin()] -= d
        return p

    return probs.map(one)


@F.pandas_udf(T.StringType())
def dinucleotide_shuffled(s: pd.Series, seed: pd.Series) -> pd.Series:
    """A shuffle that keeps dinucleotide counts and both end letters: a random Euler path, drawn from the seed."""
    def one(t: str, n: int) -> str:
        if len(t) < 3:
            return t
        rng, nexts = np.random.default_rng(abs(int(n))), {}
        for a, b in zip(t, t[1:]):
            nexts.setdefault(a, []).append(b)
        for out in nexts.values():  # the last way out of each letter stays, which keeps a path to the end
            out[:-1] = rng.permutation(out[:-1]).tolist()
        path, used = [t[0]], dict.fromkeys(nexts, 0)
        for _ in range(len(t) - 1):
            a = path[-1]
            path.append(nexts[a][used[a]])
            used[a] += 1
        return "".join(path)

    return pd.Series([one(t, n) for t, n in zip(s, seed, strict=True)])


def information_content(p: list[Column], pseudo: float = 0.001) -> Column:
    """Of a motif position's four probabilities, against a uniform background, in bits."""
    q = [(x + pseudo) / (1 + 4 * pseudo) for x in p]
    return sum((x * F.log2(x / 0.25) for x in q[1:]), q[0] * F.log2(q[0] / 0.25))


def joint_profiles(plus: Column, minus: Column, log_count: Column) -> Column:
    """Both strands' logits as one softmax, times the exponent of the log count: a struct of plus and minus."""
    scaled = F.transform(F.array(F.struct(softmax(F.concat(plus, minus)).alias("p"), F.exp(log_count).alias("c"))), lambda r: F.transform(r["p"], lambda x: x * r["c"]))[0]
    return let(F.struct(scaled.alias("p"), F.size(plus).alias("n")), lambda r: F.struct(F.slice(r["p"], F.lit(1), r["n"]).alias("plus"), F.slice(r["p"], r["n"] + 1, F.size(r["p"])).alias("minus")))


def strand_swapped(plus: Column, minus: Column) -> Column:
    """The reverse complement of a stranded profile: positions flipped, strands exchanged."""
    return F.struct(F.reverse(minus).alias("plus"), F.reverse(plus).alias("minus"))


def max_normalised(a: Column) -> Column:
    """a over its maximum; a maximum of 0 divides by 1."""
    return let(F.struct(a.alias("a"), F.coalesce(F.nullif(F.array_max(a), F.lit(0.0)), F.lit(1.0)).alias("m")), lambda r: F.transform(r["a"], lambda x: x / r["m"]))


def centre_cut(a: Column, n: int) -> Column:
    """The middle n elements."""
    return F.slice(a, F.floor((F.size(a) - n) / 2).cast("int") + 1, F.lit(n))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def without_nan(x: Column) -> Column:
    """Null and NaN as 0, infinities as the largest finite numbers."""
    most = 1.7976931348623157e308
    return F.greatest(F.lit(-most), F.least(F.lit(most), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def weighted_sum_of_logits(a: Column) -> Column:
    """Logits less their mean, weighted by their softmax and added up."""
    centred = let(F.struct(a.alias("a"), (total(a) / F.size(a)).alias("m")), lambda r: F.transform(r["a"], lambda x: x - r["m"]))
    return let(centred, lambda c: total(F.zip_with(softmax(c), c, lambda p, x: p * x)))


def projected(hot: Column, scores: Column) -> Column:
    """The score of the base present at each position: one-hot rows times score rows, added up."""
    return F.zip_with(hot, scores, lambda h, s: total(F.zip_with(h, s, lambda x, y: x * y)))


def exponential_pdf(x: Column, rate: Column) -> Column:
    return rate * F.exp(-rate * x)


def exponential_cdf(x: Column, rate: Column) -> Column:
    return 1 - F.exp(-rate * x)


def hit_p_value(score: Column, mode: Column, rate: Column, least: Column, most: Column) -> Column:
    """The exponential tail at score less mode, kept between the least and most score; at the least for what is not finite."""
    at = F.when(finite(score), F.least(most, F.greatest(least, score - mode))).otherwise(least)
    return F.exp(-rate * at)


def logo_heights(p: list[Column], background: float = 0.25, pseudo: float = 0.001) -> list[Column]:
    """Each probability times the column's information as logos scale it: its logarithms have pseudocounts, its weights don't."""
    ic = sum((F.log2((x + pseudo) / (1 + 4 * pseudo)) * x for x in p[1:]), F.log2((p[0] + pseudo) / (1 + 4 * pseudo)) * p[0]) - 4 * background * math.log2(background)
    return [x * ic for x in p]


def seqlet_shift(x: Column, input_length: int, cut: int, profile_length: int | None = None) -> Column:
    """A place in the cut middle of an input as a place in the input, or, with profile_length, in its profile."""
    at = x + (input_length - cut) // 2
    return at if profile_length is None else at - (input_length - profile_length) // 2


#: Losses by name: each takes the true and the predicted log count.
LOSSES: dict[str, Callable[[Column, Column], Column]] = {"MSE": lambda y, p: (y - p) * (y - p), "POISSON": lambda y, p: F.exp(p) - y * p}


def count_loss(name: str, y: Column, p: Column) -> Column:
    if name.upper() not in LOSSES:
        raise ValueError(f"no loss named {name}")
    return LOSSES[name.upper()](y, p)
