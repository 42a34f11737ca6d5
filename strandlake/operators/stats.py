"""Statistics as window and aggregate queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .keys import frequency_joined, running_counts, with_row
from .tables import stored


def average_ranks(df: DataFrame, column: str, keys: list[str], name: str) -> DataFrame:
    """Ranks within keys, of which each is one task's work: for keys of bounded groups."""
    w = W.partitionBy(*keys)
    return df.withColumn(name, F.rank().over(w.orderBy(column)) + (F.count("*").over(W.partitionBy(*keys, column)) - 1) / 2)


def spread_ranks(df: DataFrame, column: str, keys: list[str], name: str) -> DataFrame:
    """average_ranks() for groups of any size, and values that most rows share."""
    ranks = running_counts(df, column, keys).select(*keys, column, "_n", (F.col("_below") + (F.col("_n") + 1) / 2).alias(name))
    return frequency_joined(df, ranks, [*keys, column], "_n")


def correlation(x: str, y: str) -> Column:
    """Pearson's, as an aggregate; 0 where either is constant."""
    return F.coalesce(F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str, keys: list[str], ranks: Callable[..., DataFrame] = average_ranks) -> DataFrame:
    """Correlation of average ranks; 0 where either is constant."""
    ranked = ranks(ranks(df, x, keys, "_rx"), y, keys, "_ry")
    return ranked.groupBy(*keys).agg(correlation("_rx", "_ry").alias("spearman"))


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str], fdr: float) -> DataFrame:
    """Rows whose p is at most the largest one under rank / n * fdr, within keys of any size."""
    ranked = running_counts(df, p, keys)
    n = ranked.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    passing = with_row(ranked, n, keys).filter(F.col(p) <= (F.col("_below") + F.col("_n")) / F.col("_total") * fdr)
    cuts = passing.groupBy(*keys).agg(F.max(p).alias("_cut"), F.max("_total").alias("_total"))
    return frequency_joined(df, cuts, keys, "_total").filter(F.col(p) <= F.col("_cut")).drop("_cut")


def quantiles(df: DataFrame, column: str, keys: list[str], at: dict[str, float]) -> DataFrame:
    """keys and a column for each quantile: exact, between neighbours in proportion, for groups of any size; nulls don't count."""
    return standing(running_counts(df.filter(F.col(column).isNotNull()), column, keys), column, keys, at)


def standing(ranked: DataFrame, column: str, keys: list[str], at: dict[str, float]) -> DataFrame:
    """quantiles() of running_counts()."""
    n = ranked.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    v = F.col(column).cast("double")

    def value(place: Column) -> Column:
        return F.max(F.when((F.col("_below") <= place) & (place < F.col("_below") + F.col("_n")), v))

    out = []
    for name, q in at.items():
        place = q * (F.col("_total") - 1)
        low, high = value(F.floor(place)), value(F.ceil(place))
        out.append((low + F.max(place - F.floor(place)) * (high - low)).alias(name))
    return with_row(ranked, n, keys).groupBy(*keys).agg(*out)


def quantile_trim(df: DataFrame, column: str, q: float, scale: float) -> DataFrame:
    """Rows up to scale times the value nearest the q-quantile (the smaller on a tie).

    Both numbers come from the values and how often they occur; the rows are stored for the
    counts and the filter.
    """
    df = stored(df)
    ranked = running_counts(df.filter(F.col(column).isNotNull()), column, [])
    limit = standing(ranked, column, [], {"_q": q})
    near = ranked.join(F.broadcast(limit)).agg(F.min_by(column, F.struct(F.abs(F.col(column) - F.col("_q")), F.col(column))).alias("_near"))
    return df.join(F.broadcast(near)).filter(F.col(column) <= F.col("_near") * scale).drop("_near")


def histogram_mode(df: DataFrame, column: str, keys: list[str], bins: int = 200) -> DataFrame:
    """The middle of the fullest of equal bins between the extremes, the first on a tie; the last bin is closed."""
    ends = df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.count("*").alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col(column) - F.col("_lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    counts = frequency_joined(df, ends, keys, "_n").groupBy(*keys, "_lo", "_hi", F.coalesce(b, F.lit(0)).alias("_b")).agg(F.count("*").alias("_n"))
    best = F.max(F.struct("_n", (-F.col("_b")).alias("b")))
    top = counts.groupBy(*keys, "_lo", "_hi").agg(best.alias("m"))
    return top.select(*keys, (F.col("_lo") + width * (0.5 - F.col("m.b"))).alias("mode"), F.col("m._n").alias("n"))


def iqr_clipped(df: DataFrame, column: str, keys: list[str], low: float = 0.25, high: float = 0.7) -> DataFrame:
    """Rows within 1.5 spreads of the low and high quantiles."""
    q = with_row(quantiles(df, column, keys, {"_a": low, "_b": high}), df.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    reach = 1.5 * (F.col("_b") - F.col("_a"))
    return frequency_joined(df, q, keys, "_n").filter(F.col(column).between(F.col("_a") - reach, F.col("_b") + reach)).drop("_a", "_b")


def early_stop(history: DataFrame, patience: int, min_delta: float) -> DataFrame:
    """history (epoch, loss), a row an epoch: stop where none of the last patience losses beats the one before them by over min_delta."""
    w = W.orderBy("epoch")
    out = history.withColumn("_anchor", F.lag("loss", patience).over(w)).withColumn("_best", F.min("loss").over(w.rowsBetween(1 - patience, 0)))
    return out.select("epoch", "loss", F.coalesce(F.col("_best") >= F.col("_anchor") - min_delta, F.lit(False)).alias("stop"), (F.col("loss") < F.coalesce(F.min("loss").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(float("inf")))).alias("best_so_far"))


def plateau_rates(history: DataFrame, patience: int, rate: float, factor: float = 0.5, least: float = 1e-4) -> DataFrame:
    """history (epoch, loss), a row an epoch, with the learning rate after it: times factor where none of the last patience losses is below the one before them, unless that falls below least."""
    w = W.orderBy("epoch")
    flat = F.coalesce(F.min("loss").over(w.rowsBetween(1 - patience, 0)) >= F.lag("loss", patience).over(w), F.lit(False))
    steps = 0
    while rate * factor ** (steps + 1) >= least:
        steps += 1
    cuts = F.least(F.sum(F.col("_flat").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(steps))
    return history.withColumn("_flat", flat).select("epoch", "loss", F.col("_flat").alias("plateau"), (rate * F.pow(F.lit(factor), cuts)).alias("rate"))
