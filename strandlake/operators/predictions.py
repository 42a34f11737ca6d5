"""Predicted profiles against true ones: the chain from logits to metrics, and what is stored of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import profile as pf
from . import stats


def metrics(examples: DataFrame, sigma: float = 7.0, width: int = 81, keys: tuple[str, ...] = ("id",), constant: float = 0.0) -> DataFrame:
    """examples (keys, truth, predicted: arrays) with jsd, cross_entropy, mse, pearson and spearman.

    The truth is smoothed for the distance and the cross-entropy. Where either sums to 0 all
    metrics stay 0; correlations with a constant array are 0, or what constant says. Each row
    has its own metrics: nothing is shuffled, and columns that aren't used aren't computed.
    """
    both = (pf.total(F.col("truth")) != 0) & (pf.total(F.col("predicted")) != 0)
    x = examples.select(*keys, *(F.col(c) for c in ("truth", "predicted") if c not in keys), both.alias("_both"))
    x = x.withColumns({"_smooth": pf.smoothed(sigma, width)(F.col("truth")), "_rt": pf.ranks(F.col("truth")), "_rp": pf.ranks(F.col("predicted"))})
    out = {
        "jsd": pf.jensen_shannon(F.col("_smooth"), F.col("predicted")),
        "cross_entropy": pf.cross_entropy(F.col("_smooth"), pf.shares(F.col("predicted"))),
        "mse": pf.mean_square(F.col("truth"), F.col("predicted")),
    }
    flat = reduce(lambda a, b: a | b, (F.array_min(c) == F.array_max(c) for c in ("truth", "predicted")))
    alike = {"pearson": pf.correlation(F.col("truth"), F.col("predicted")), "spearman": pf.correlation(F.col("_rt"), F.col("_rp"))}
    out |= {n: F.when(flat, F.lit(constant)).otherwise(c) for n, c in alike.items()}
    return x.select(*keys, *(F.when(F.col("_both"), c).otherwise(0.0).alias(n) for n, c in out.items()))


def correlations(examples: DataFrame, track: str, truth: str, predicted: str) -> DataFrame:
    """track, pearson, spearman over all its examples; 0 where either side is constant."""
    p = examples.groupBy(track).agg(stats.correlation(truth, predicted).alias("pearson"))
    return p.join(stats.spearman(examples, truth, predicted, [track], stats.spread_ranks), track)


def metric_rows(found: DataFrame, keys: list[str]) -> DataFrame:
    """metric, keys, value: a row for each metric of each example."""
    names = [c for c in found.columns if c not in keys]
    return found.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))).alias("m")).select("m.metric", *keys, "m.value")


def summary(rows: DataFrame) -> DataFrame:
    """metric, least, middle, most of metric rows."""
    return rows.groupBy("metric").agg(F.min("value").alias("least"), F.percentile("value", 0.5).alias("middle"), F.max("value").alias("most"))


def hypothetical_contributions(rows: DataFrame, example: list[str]) -> DataFrame:
    """rows (example, reference, pos, base, multiplier, background) -> example, pos, base, contribution.

    What each base would contribute, were it there: its difference from the reference times
    the multipliers, added over the bases; the mean over references.
    """
    at = [*example, "reference", "pos"]
    was = rows.groupBy(*at).agg(F.sum(F.col("background") * F.col("multiplier")).alias("_was"))
    return rows.join(was, at).groupBy(*example, "pos", "base").agg(F.avg(F.col("multiplier") - F.col("_was")).alias("contribution"))


def first_of_each(predictions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the least order for each key."""
    rest = [c for c in predictions.columns if c not in keys]
    return predictions.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def aligned(predictions: DataFrame, attributions: DataFrame, order: str, keys: tuple[str, ...] = ("chrom", "start", "end")) -> DataFrame:
    """Attributions with the first prediction of their coordinates, in the order of the attributions' index."""
    return attributions.join(first_of_each(predictions, list(keys), order), list(keys)).orderBy("attribution_index")
