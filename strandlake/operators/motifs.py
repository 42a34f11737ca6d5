"""Motif hits and models: counts, co-occurrence, distances, ensembles, scanning and mixtures."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import profile as pf
from . import stats
from .stats import correlation
from .tables import stored


def cooccurrence(hits: DataFrame) -> DataFrame:
    """key_a, key_b, peaks with both; on the diagonal, peaks with two hits or more. Hits are counted by peak and key first."""
    n = hits.groupBy("peak", "key").agg(F.count("*").alias("n"))
    pairs = n.select("peak", F.col("key").alias("key_a"), F.col("n").alias("_a")).join(n.select("peak", F.col("key").alias("key_b")), "peak")
    return pairs.filter("key_a <> key_b or _a >= 2").groupBy("key_a", "key_b").agg(F.count("*").alias("peaks"))


@F.pandas_udf(T.DoubleType())
def fisher_greater(both: pd.Series, a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    """P(at least both) of the hypergeometric distribution with a and b of n."""
    def log_choose(x: int, y: int) -> float:
        return math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)

    def one(k: int, a: int, b: int, n: int) -> float:
        whole = log_choose(n, b)
        return min(1.0, sum(math.exp(log_choose(a, i) + log_choose(n - a, b - i) - whole) for i in range(max(k, a + b - n), min(a, b) + 1)))

    return pd.Series([one(*map(int, r)) for r in zip(both, a, b, n, strict=True)])


@F.pandas_udf(T.DoubleType())
def poisson_greater(k: pd.Series, mean: pd.Series) -> pd.Series:
    """P(more than k) of the Poisson distribution; terms 40 standard deviations away count as 0."""

    def one(k: int, mu: float) -> float:
        if mu <= 0:
            return 0.0
        reach = 40 * math.sqrt(mu) + 100
        if k > mu + reach:
            return 0.0
        return max(0.0, 1 - sum(math.exp(i * math.log(mu) - mu - math.lgamma(i + 1)) for i in range(max(0, int(mu - reach)), k + 1)))

    return pd.Series([one(int(a), float(b)) for a, b in zip(k, mean, strict=True)])


def self_cooccurrence(hits: DataFrame) -> DataFrame:
    """key, peaks with it, peaks with two hits or more, and the chance of more such peaks were its hits dealt at random to all peaks."""
    peaks = hits.select("peak").distinct().agg(F.count("*").alias("_all"))
    n = hits.groupBy("peak", "key").agg(F.count("*").alias("_n")).groupBy("key").agg(F.count("*").alias("peaks"), F.sum((F.col("_n") >= 2).cast("long")).alias("repeated"))
    mean = F.col("peaks") * (F.col("peaks") - 1) / (2 * F.col("_all"))
    return n.join(F.broadcast(peaks)).select("key", "peaks", "repeated", poisson_greater("repeated", mean).alias("p"))


def trimmed(motifs: DataFrame, least: float = 0.2, pad: int = 0) -> DataFrame:
    """Positions (key, pos, ic, ...) from the first to the last of information content least or more, and pad around; all, where none has it."""
    w = W.partitionBy("key")
    passing = F.when(F.col("ic") >= least, F.col("pos"))
    ends = motifs.withColumn("_first", F.min(passing).over(w)).withColumn("_last", F.max(passing).over(w))
    return ends.filter(F.col("_first").isNull() | F.col("pos").between(F.col("_first") - pad, F.col("_last") + pad)).drop("_first", "_last")


def pair_distances(hits: DataFrame) -> DataFrame:
    """For each hit and other key of its peak: the nearest non-overlapping hit's signed distance of centres, negative on a tie.

    The greatest centre of hits that end before, and the least of those that start behind, come from sorted passes over (peak, key), not from pairs of hits.
    """
    centre = F.floor((F.col("start") + F.col("end")) / 2)
    h = hits.filter("start is not null and end is not null").select("id", "peak", "key", "start", "end", centre.alias("c"))
    asking = h.join(h.select("peak", F.col("key").alias("key_b")).distinct(), "peak").filter("key <> key_b")
    asking = asking.select("peak", "key_b", "id", "key", "c", F.col("start").alias("_low"), F.col("end").alias("_high"), F.lit(None).cast("long").alias("_c"))
    there = h.select("peak", F.col("key").alias("key_b"), F.lit(None).cast(h.schema["id"].dataType).alias("id"), F.lit(None).cast(h.schema["key"].dataType).alias("key"), F.lit(None).cast("long").alias("c"), F.col("end").alias("_low"), F.col("start").alias("_high"), F.col("c").alias("_c"))
    w = W.partitionBy("peak", "key_b")
    near = asking.unionByName(there).select("*", F.max("_c").over(w.orderBy("_low").rangeBetween(W.unboundedPreceding, 0)).alias("_b"), F.min("_c").over(w.orderBy("_high").rangeBetween(0, W.unboundedFollowing)).alias("_a"))
    back, on = F.col("_b") - F.col("c"), F.col("_a") - F.col("c")
    found = F.when(on.isNull() | (-back <= on), back).otherwise(on)
    return near.filter("key is not null and (_a is not null or _b is not null)").select("id", "key", "key_b", found.alias("distance"))


def ensemble_mean(members: DataFrame, n_members: int) -> DataFrame:
    """members (coord, member, pos, p, log_total): the geometric mean of probabilities, made to sum to 1, times the exponent of the mean log total. Coordinates that not all members have are left out."""
    whole = members.groupBy("coord").agg(F.countDistinct("member").alias("m"), F.avg("log_total").alias("lt")).filter(F.col("m") == n_members)
    g = members.groupBy("coord", "pos").agg(F.exp(F.avg(F.log("p"))).alias("g"))
    s = F.sum("g").over(W.partitionBy("coord"))
    return g.withColumn("s", s).join(whole, "coord").select("coord", "pos", (F.col("g") / F.col("s") * F.exp("lt")).alias("value"))


#: Letters that a first look at a motif reads at once, by a table of all words of that length.
LOOK = 6
#: Bytes that the matrices of one scan, which every task gets, may have.
MOST_BYTES = 64 << 20


class Stack:
    """Score matrices (L x 4) with thresholds, ready to look up both strands at once.

    Each matrix has a table of what its most telling LOOK neighbouring columns score on every
    word of that length. A place where these, with the best that the other columns can add, miss
    the threshold is done with; the others are scored column by column.
    """

    def __init__(self, pwms: dict[str, np.ndarray], thresholds: dict[str, float]):
        self.motifs = []
        for key, m in pwms.items():
            for strand, w in (("+", np.asarray(m, float)), ("-", np.asarray(m, float)[::-1, ::-1])):
                n, k = len(w), min(LOOK, len(w))
                spread = w.max(axis=1) - w.min(axis=1)
                at = int(np.argmax([spread[i : i + k].sum() for i in range(n - k + 1)]))
                words = np.zeros(1)
                for row in w[at : at + k]:
                    words = (words[:, None] + row[None, :]).ravel()
                rest = w.max(axis=1).sum() - w[at : at + k].max(axis=1).sum()
                passing = np.append(words + rest >= thresholds[key] - 1e-9, False)
                self.motifs.append((key, strand, np.c_[w, np.full(n, -np.inf)], thresholds[key], k, at, passing))
        if sum(x[2].nbytes + x[6].nbytes for x in self.motifs) > MOST_BYTES:
            raise ValueError("too many matrices for one scan")
        self.longest = max((len(x[2]) for x in self.motifs), default=0)

    def hits(self, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number of the motif, places and scores, on letters as 0 to 3, or 4 for what no hit may hold."""
        x = letters.astype(np.int64)
        words = {}
        for number, (_, _, w, least, k, at, passing) in enumerate(self.motifs):
            n = len(x) - len(w) + 1
            if n <= 0:
                continue
            if k not in words:
                code, bad = np.zeros(len(x) - k + 1, np.int64), np.zeros(len(x) - k + 1, bool)
                for i in range(k):
                    part = x[i : len(x) - k + 1 + i]
                    code, bad = code * 4 + np.minimum(part, 3), bad | (part == 4)
                words[k] = np.where(bad, 4**k, code)
            some = np.flatnonzero(passing[words[k][at : at + n]])
            score = np.zeros(len(some))
            for i, row in enumerate(w):
                score += row[x[some + i]]
            good = score >= least - 1e-9  # thresholds are multiples of a step
            if good.any():
                yield number, some[good], score[good]


BASE = np.full(256, 4, np.int8)
for _i, _b in enumerate(b"ACGT"):
    BASE[_b] = _i
HITS = "chrom string, start long, end long, key string, strand string, score double"


#: Letters that are scanned at once; a longer chunk is scanned whole.
SCANNED = 1 << 18


def _scanned(chunks: DataFrame, stack: Stack, starts: str | None = None) -> DataFrame:
    """Hits on chunks (chrom, start, seq) that start at one of the first letters, as many as the column starts says.

    Chunks are scanned many at once, an unknown letter between them, so short ones cost no more than long ones.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys, strands = (pa.array([x[i] for x in stack.motifs], pa.string()) for i in (0, 1))
        longs = np.array([len(x[2]) for x in stack.motifs], np.int64)
        for batch in batches:
            seqs = [(s or "").encode("latin-1", "replace") for s in batch.column(2).to_pylist()]
            size = np.fromiter(map(len, seqs), np.int64, len(seqs))
            first, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3))
            at = 0
            while at < len(seqs):
                to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), SCANNED, "right")) + at)
                begin = np.concatenate([[0], np.cumsum(size[at:to] + 1)])
                found = list(stack.hits(BASE[np.frombuffer(b"N".join(seqs[at:to]) + b"N", np.uint8)]))
                if found:
                    number = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                    place, score = (np.concatenate([f[i] for f in found]) for i in (1, 2))
                    row = np.searchsorted(begin, place, "right") - 1
                    inside = place - begin[row] < own[at:to][row]
                    number, place, score, row = number[inside], place[inside], score[inside], row[inside]
                    start = first[at:to][row] + place - begin[row]
                    pick = pa.array(number)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + at)), pa.array(start), pa.array(start + longs[number]), keys.take(pick), strands.take(pick), pa.array(score)], names=["chrom", "start", "end", "key", "strand", "score"])
                at = to

    n = F.lit(1 << 40).cast("long") if starts is None else F.col(starts).cast("long")
    return chunks.select(F.col("chrom").cast("string").alias("chrom"), F.col("start").cast("long").alias("start"), "seq", n.alias("_n")).mapInArrow(run, HITS)


def scan_pwm(chunks: DataFrame, pwms: dict[str, np.ndarray], threshold: float) -> DataFrame:
    """Hits of L x 4 score matrices on chunks (chrom, start, seq) on both strands, with scores of at least threshold. Chunks must overlap by the longest matrix less 1."""
    return _scanned(chunks, Stack(pwms, dict.fromkeys(pwms, threshold)))


def with_halos(chunks: DataFrame, halo: int, size: int) -> DataFrame:
    """chunks (chrom, chunk_id, start, seq; size letters each but a contig's last) with seq running on by halo letters of the chunks after it, and own, the letters of the chunk itself.

    Only heads of chunks are sent on, to as many chunks before as they reach.
    """
    own = chunks.select("chrom", "chunk_id", "start", "seq", F.length("seq").alias("own"))
    if halo <= 0:
        return own
    back = F.explode(F.sequence(F.lit(1), F.lit(-(-halo // size)))).alias("_j")
    head = F.substring("seq", F.lit(1), F.least(F.lit(halo) - (F.col("_j") - 1) * size, F.lit(size)))
    sent = chunks.select("chrom", "chunk_id", "seq", back).select("chrom", (F.col("chunk_id") - F.col("_j")).alias("chunk_id"), F.struct("_j", head.alias("s")).alias("h"))
    tails = sent.groupBy("chrom", "chunk_id").agg(F.array_sort(F.collect_list("h")).alias("_h"))
    tail = F.array_join(F.transform("_h", lambda h: h["s"]), "")
    return own.join(tails, ["chrom", "chunk_id"], "left").select("chrom", "chunk_id", "start", F.concat("seq", F.coalesce(tail, F.lit(""))).alias("seq"), "own")


def scan(chunks: DataFrame, pwms: dict[str, np.ndarray], size: int, p: float = 1e-4, background: tuple[float, ...] = (0.25,) * 4, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Hits of all score matrices in one pass over chunks (chrom, chunk_id, start, seq; size letters), each hit once, across chunks' borders too.

    A matrix's threshold, where none is given, is what random letters of the background reach
    with probability under p. Null sequences are empty.
    """
    least = {k: score_threshold(m, p, background=background) for k, m in pwms.items()} | (thresholds or {})
    stack = Stack(pwms, least)
    return _scanned(with_halos(chunks.filter("seq is not null"), stack.longest - 1, size), stack, "own")


def scored(examples: DataFrame, scorer: Callable[[list[str]], list[list[float]]], column: str = "seq") -> DataFrame:
    """examples with logits from any function of a list of sequences, called on Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield df.assign(logits=scorer(df[column].tolist()))

    return examples.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in examples.schema.fields) + ", logits array<double>")


def strand_average(predictions: DataFrame) -> DataFrame:
    """predictions (locus_id, rev_comp, profile, log_count): forward and flipped reverse averaged, position by position."""
    fwd = predictions.filter("not rev_comp").select("locus_id", F.col("profile").alias("f"), F.col("log_count").alias("lf"))
    rev = predictions.filter("rev_comp").select("locus_id", F.reverse("profile").alias("r"), F.col("log_count").alias("lr"))
    return fwd.join(rev, "locus_id").select("locus_id", F.zip_with("f", "r", lambda a, b: (a + b) / 2).alias("profile"), ((F.col("lf") + F.col("lr")) / 2).alias("log_count"))


def score_threshold(matrix: np.ndarray, p: float = 1e-4, step: float = 0.01, background: tuple[float, ...] = (0.25,) * 4) -> float:
    """The least score that a random sequence of the background's bases reaches with probability under p, by the distribution of scores in steps; the matrix is one motif's."""
    grid = np.round(np.asarray(matrix, float) / step).astype(int)
    dist, low = np.ones(1), 0
    for row in grid:
        shift = row - row.min()
        out = np.zeros(len(dist) + shift.max())
        for k, q in zip(shift, background, strict=True):
            out[k : k + len(dist)] += dist * q
        dist, low = out, low + row.min()
    tail = np.cumsum(dist[::-1])[::-1]
    return (low + int(np.searchsorted(-tail, -p, "right"))) * step


#: Bytes of the catalogue that every task gets.
MOST_CATALOGUE = 128 << 20


def similarity(queries: DataFrame, targets: DataFrame, least: int = 5) -> DataFrame:
    """Motif rows (motif, pos, a, c, g, t) of queries and targets -> query, target, correlation, offset, strand.

    Pearson correlation of the columns that overlap, least or more of them, at the offset and
    strand (of the target) where it is greatest; ties go to the least offset, then '+'.
    Positions count from each motif's first. Pairs that nowhere overlap so far are left out.

    The targets, stored once and checked for size when this is called, go to every task; queries
    stay where they are: a motif is one row with its cells as an array, and meets all targets offset by offset as arrays.
    """
    cell = F.array(*(F.col(b).cast("double") for b in "acgt"))

    def whole(df: DataFrame) -> DataFrame:
        return df.groupBy("motif").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", cell.alias("v")))), lambda r: r["v"])).alias("v"), F.min("pos").alias("first"))

    catalogue = stored(whole(targets))
    if (catalogue.agg(F.sum(F.size("v"))).first()[0] or 0) * 8 * 2 > MOST_CATALOGUE:
        raise ValueError("too many targets for every task to hold")
    rows = catalogue.orderBy("motif").collect()  # of checked size
    names = [r["motif"] for r in rows]
    known: dict[tuple[int, int], list] = {}
    for i, r in enumerate(rows):
        known.setdefault((len(r["v"]) // 4, r["first"]), []).append((i, np.array(r["v"]).reshape(-1, 4)))
    groups = [(first, np.array([i for i, _ in x]), np.stack([m for _, m in x])) for (_, first), x in sorted(known.items())]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for q, v, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.array(v).reshape(-1, 4)
                for start, which, y in groups:
                    best = np.full(len(which), -np.inf)
                    offset, back = np.zeros(len(which), np.int64), np.zeros(len(which), bool)
                    for off in range(least - y.shape[1], len(x) - least + 1):
                        a, b = max(0, off), min(len(x), off + y.shape[1])
                        if b - a < least:
                            continue
                        u = x[a:b].ravel() - x[a:b].mean()
                        for minus in (False, True):
                            part = (y[:, ::-1, ::-1] if minus else y)[:, a - off : b - off].reshape(len(which), -1)
                            part = part - part.mean(axis=1, keepdims=True)
                            scale = np.sqrt((u @ u) * (part * part).sum(axis=1))
                            c = np.round(np.where(scale > 1e-12, (part @ u) / np.where(scale > 1e-12, scale, 1.0), 0.0), 12)
                            new = c > best
                            best, offset, back = np.where(new, c, best), np.where(new, off, offset), np.where(new, minus, back)
                    some = np.flatnonzero(best > -np.inf)
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array([q] * len(some), batch.column(0).type), pa.array([names[i] for i in which[some].tolist()], kind), pa.array(best[some]), pa.array(offset[some] + first - start), pa.array(np.where(back[some], "-", "+").tolist())], names=["query", "target", "correlation", "offset", "strand"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(targets.schema["motif"].dataType)
    schema = f"query {queries.schema['motif'].dataType.simpleString()}, target {targets.schema['motif'].dataType.simpleString()}, correlation double, offset long, strand string"
    return whole(queries).select("motif", "v", "first").mapInArrow(run, schema)


FIT = {"weight": 0, "rate": 1, "weight_1": 2, "mean_1": 3, "sd_1": 4, "weight_2": 5, "mean_2": 6, "sd_2": 7}
#: Cells between the extremes that values are counted in for the mixture.
CELLS = 1 << 16


def fitted_mixture(values: DataFrame, column: str, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """One row, of the parameters in FIT: one exponential and two normals fitted to values of 0 or more by EM, until the mean log-likelihood grows by less than tolerance.

    The statistics that EM needs add up over values, so they are counted in CELLS cells
    between the extremes first, a cell standing at its mean; the rounds then run over these,
    at most CELLS rows, in one task of the same job. Where different values lie further apart
    than the cells are wide, the result is that of EM over the values. The start: the
    exponential of the mean, normals at the mean and three times the mean, equal weights.
    Null values don't count; without values the row is null.
    """
    x = F.col(column).cast("double")
    v = values.select(x.alias("_v")).filter("_v is not null")
    ends = v.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    cell = F.least(F.floor((F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * CELLS), F.lit(CELLS - 1))
    cells = v.join(F.broadcast(ends)).groupBy(F.coalesce(cell, F.lit(0)).alias("_c")).agg(F.count("*").cast("double").alias("n"), F.avg("_v").alias("x"))

    def em(table):
        import pyarrow as pa

        n, at = table.column("n").to_numpy(), table.column("x").to_numpy()
        by = np.argsort(at)
        found = _em(at[by], n[by], rounds, tolerance)
        return pa.table({k: [float(p)] for k, p in zip(FIT, found, strict=True)})

    return cells.select(F.lit(1).alias("_one"), "n", "x").groupBy("_one").applyInArrow(em, ", ".join(f"{k} double" for k in FIT))


def _em(x: np.ndarray, n: np.ndarray, rounds: int, tolerance: float) -> tuple[float, ...]:
    total = n.sum()
    mean = max((x * n).sum() / total, 1e-12)
    sd = max(math.sqrt(max((x * x * n).sum() / total - ((x * n).sum() / total) ** 2, 0.0)), 1e-12)
    w, rate, mu, dev, before = np.full(3, 1 / 3), 1 / mean, np.array([mean, 3 * mean]), np.full(2, sd), -math.inf
    for _ in range(rounds):
        part = np.stack([w[0] * rate * np.exp(-rate * x), *(w[k + 1] / (dev[k] * math.sqrt(2 * math.pi)) * np.exp(-((x - mu[k]) ** 2) / (2 * dev[k] ** 2)) for k in (0, 1))])
        whole = np.maximum(part.sum(axis=0), 1e-300)
        like = (np.log(whole) * n).sum() / total
        if like - before < tolerance:
            break
        before, r = like, part / whole * n
        s, sx, sxx = r.sum(axis=1), (r * x).sum(axis=1), (r * x * x).sum(axis=1)
        w, rate = s / total, s[0] / max(sx[0], 1e-12)
        mu = sx[1:] / np.maximum(s[1:], 1e-12)
        dev = np.sqrt(np.maximum(sxx[1:] / np.maximum(s[1:], 1e-12) - mu * mu, 1e-12))
    return w[0], rate, w[1], mu[0], dev[0], w[2], mu[1], dev[1]


def score_mixture(values: DataFrame, column: str, rounds: int = 100, tolerance: float = 1e-6) -> dict[str, float]:
    """fitted_mixture() as a dictionary."""
    return fitted_mixture(values, column, rounds, tolerance).first().asDict()


def exponential_part(values: DataFrame, column: str, fit: dict[str, float] | DataFrame) -> DataFrame:
    """Values of which the exponential is the likeliest component; fit: parameters, or the row of them."""
    x = F.col(column)
    lazy = isinstance(fit, DataFrame)
    g = {k: F.col(f"_fit.{k}") if lazy else F.lit(float(fit[k])) for k in FIT}

    def log(c: Column) -> Column:
        return F.log(F.greatest(c, F.lit(1e-300)))

    first = log(g["weight"] * g["rate"]) - g["rate"] * x
    others = [log(g[f"weight_{k}"] / (g[f"sd_{k}"] * math.sqrt(2 * math.pi))) - (x - g[f"mean_{k}"]) * (x - g[f"mean_{k}"]) / (2 * g[f"sd_{k}"] * g[f"sd_{k}"]) for k in (1, 2)]
    own = values.join(F.broadcast(fit.select(F.struct(*FIT).alias("_fit")))) if lazy else values
    return own.filter((first >= others[0]) & (first >= others[1])).select(*values.columns)


TAILS = [k / 20 for k in range(1, 20)]


def tightest(values: DataFrame, column: str, mode: float = 0.0) -> DataFrame:
    """One row, rate: the greatest rate of exponentials fitted to the 5th, 10th, .. 95th percentile of values of the mode or more; 1 without any."""
    q = stats.quantiles(values.filter(F.col(column) >= mode), column, [], {f"q{i}": p for i, p in enumerate(TAILS)})
    rates = F.array(*(F.when(F.col(f"q{i}") > mode, F.lit(-math.log(1 - p)) / (F.col(f"q{i}") - mode)) for i, p in enumerate(TAILS)))
    return q.select(F.coalesce(F.array_max(rates), F.lit(1.0)).alias("rate"))


def tight_rate(values: DataFrame, column: str, mode: float = 0.0) -> float:
    return tightest(values, column, mode).first()[0]


def hits_by_discovery(hits: DataFrame, score: str, fdr: float = 0.05, bins: int = 200) -> DataFrame:
    """Hits (id, ...) with p, those that the false discovery rate lets pass.

    Finite scores' mode, the mixture of scores above it, the exponential's own scores, their
    tight rate as null, its tail as p. The scores are stored once when this is called, and four
    numbers come to the driver.
    """
    some = stored(hits.filter(pf.finite(F.col(score))).select(F.col(score).cast("double").alias("_s")))
    least, most, mode = some.agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi")).join(stats.histogram_mode(some, "_s", [], bins).select("mode"), how="left").first()
    rate = 1.0
    if mode is not None:
        above = some.filter(F.col("_s") >= mode).select((F.col("_s") - mode).alias("x"))
        rate = tight_rate(exponential_part(above, "x", fitted_mixture(above, "x")), "x")
    p = hits.withColumn("p", pf.hit_p_value(F.col(score), F.lit(mode), F.lit(rate), F.lit(least), F.lit(most)))
    return stats.benjamini_hochberg(p, "p", [], fdr)


def with_backgrounds(examples: DataFrame, make: Callable[..., Column], n: int, column: str = "seq") -> DataFrame:
    """A row for each of n backgrounds of each example (id, seq): make takes the sequence and a seed of its id and number."""
    each = examples.withColumn("reference", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return each.withColumn("background", make(F.col(column), F.pmod(F.xxhash64("id", "reference"), F.lit(1 << 31))))
