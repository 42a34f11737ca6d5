"""Interval algebra on (chrom, start, end), 0-based and half-open.

Range joins are equi-joins on (chrom, bin): each side is replicated to the bins it
covers, and a pair is kept in the later of the two first bins only, so no pair comes
twice and no chromosome is compared with itself as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .keys import beside, joined


def centred(loci: DataFrame, flank: int) -> DataFrame:
    """Windows of 2 * flank around st + summit."""
    pos = F.col("st") + F.col("summit")
    return loci.withColumns({"pos": pos, "start": pos - flank, "end": pos + flank})


def in_bounds(windows: DataFrame, sizes: DataFrame, strict: bool = False) -> DataFrame:
    """Windows inside their chromosome; sizes has one row a chromosome. Those of unknown chromosomes go, or with strict make the query fail."""
    if not strict:
        return windows.join(sizes, "chrom").filter("start >= 0 and end <= size").drop("size")
    known = F.coalesce("size", F.raise_error(F.concat(F.lit("unknown chromosome: "), F.coalesce("chrom", F.lit("null")))).cast("long"))
    return windows.join(sizes, "chrom", "left").withColumn("size", known).filter("start >= 0 and end <= size").drop("size")


def unknown_chroms(windows: DataFrame, sizes: DataFrame) -> DataFrame:
    return windows.join(sizes, "chrom", "left_anti").select("chrom").distinct()


def clamped(inner: DataFrame, lo: str, hi: str) -> DataFrame:
    return inner.withColumns({"start": F.greatest("start", lo), "end": F.least("end", hi)})


def binned(df: DataFrame, size: int, start: Column, end: Column) -> DataFrame:
    """A row for each bin that [start, end) touches (an empty interval touches one), with the first bin."""
    first, last = F.floor(start / size), F.floor(F.greatest(end - 1, start) / size)
    return df.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(a: DataFrame, b: DataFrame, size: int, condition: Column | None = None, how: str = "inner") -> DataFrame:
    """Pairs of a (chrom, start, end, ...) and b (chrom, b_start, b_end, ...) that overlap, or of those that meet, fulfil condition; or, by how left_semi or left_anti, the rows of a with or without such a b."""
    if how != "inner":
        # rows of a stand for themselves, nulls in any column included: equal rows all meet or all don't
        key = F.struct(*(F.col(c) for c in a.columns))
        hit = overlap_join(a, b.select("chrom", "b_start", "b_end"), size, condition).select(key.alias("_row")).distinct()
        return a.withColumn("_row", key).join(hit, "_row", how).drop("_row")
    left = binned(a, size, F.col("start"), F.col("end")).withColumnRenamed("_first", "_fa")
    right = binned(b, size, F.col("b_start"), F.col("b_end")).withColumnRenamed("_first", "_fb")
    met = condition if condition is not None else (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    return left.join(right, ["chrom", "_bin"]).filter(met & (F.col("_bin") == F.greatest("_fa", "_fb"))).drop("_bin", "_fa", "_fb")


def without_blacklisted(peaks: DataFrame, regions: DataFrame, size: int, mode: str = "ends") -> DataFrame:
    """Peaks (with a key column id) of which, by 'ends', neither start nor end lies in a closed region; by 'overlap', none overlaps."""
    closed = ((F.col("b_start") <= F.col("start")) & (F.col("b_end") >= F.col("start"))) | ((F.col("b_start") <= F.col("end")) & (F.col("b_end") >= F.col("end")))
    if mode == "overlap":
        closed = (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    # closed ends touch one place more on both sides
    wide = peaks.select("id", "chrom", "start", "end")
    left = binned(wide, size, F.col("start"), F.col("end") + 1)
    right = binned(regions.select("chrom", "b_start", "b_end"), size, F.col("b_start"), F.col("b_end") + 1).drop("_first")
    bad = left.join(right, ["chrom", "_bin"]).filter(closed).select("id").distinct()
    return peaks.join(bad, "id", "left_anti")


def contained(inner: DataFrame, outer: DataFrame, size: int) -> DataFrame:
    """Pairs where [start, end) lies wholly in [b_start, b_end)."""
    return overlap_join(inner, outer, size, (F.col("start") >= F.col("b_start")) & (F.col("end") <= F.col("b_end")))


def lists_of_contained(inner: DataFrame, outer: DataFrame, size: int) -> DataFrame:
    """outer (chrom, b_start, b_end, ...) with found: the sorted ids of the rows of inner (id, chrom, start, end) that lie wholly in it, none where none do.

    Rows of equal bounds are one on either side, so what is joined and shuffled grows with
    different bounds and the ids between them, not with pairs of rows.
    """
    alike = inner.groupBy("chrom", "start", "end").agg(F.collect_list("id").alias("_ids"))
    bounds = outer.select("chrom", "b_start", "b_end").distinct()
    lists = contained(alike, bounds, size).groupBy("chrom", "b_start", "b_end").agg(F.array_sort(F.flatten(F.collect_list("_ids"))).alias("found"))
    other = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in ("chrom", "b_start", "b_end")]
    met = outer.join(lists.withColumnsRenamed({k: f"_of_{k}" for k in ("chrom", "b_start", "b_end")}).hint("merge"), other, "left")
    none = F.array().cast(inner.select(F.array("id")).schema[0].dataType)
    return met.select(*outer.columns, F.coalesce("found", none).alias("found"))


def coverage_sums(loci: DataFrame, track: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """Sum of value times overlap for each locus; 0 without coverage."""
    t = track.select("chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"), "value")
    over = F.least("end", "b_end") - F.greatest("start", "b_start")
    sums = overlap_join(loci, t, size).groupBy(*keys).agg(F.sum(F.col("value") * over).alias("total"))
    return loci.join(sums, keys, "left").withColumn("total", F.coalesce("total", F.lit(0)))


def hit_importance(hits: DataFrame, track: DataFrame, size: int) -> DataFrame:
    """hits (id, chrom, start, end in the locus [lo, hi)) with the mean of the absolute track over the hit, over the locus's total; null where that is 0."""
    absolute = track.withColumn("value", F.abs("value"))
    own = coverage_sums(hits.select("id", "chrom", "start", "end"), absolute, size, ["id", "chrom", "start", "end"]).select("id", F.col("total").alias("_own"))
    whole = coverage_sums(hits.select("id", "chrom", F.col("lo").alias("start"), F.col("hi").alias("end")), absolute, size, ["id", "chrom", "start", "end"]).select("id", F.col("total").alias("_whole"))
    return hits.join(own, "id").join(whole, "id").withColumn("importance", F.col("_own") / (F.col("end") - F.col("start")) / F.nullif("_whole", F.lit(0))).drop("_own", "_whole")


def nearest(points: DataFrame, targets: DataFrame, size: int) -> DataFrame:
    """points (id, chrom, pos) with the signed distance to the nearest target (chrom, pos), the smaller position on a tie.

    Distances are those of places, which points share: each place is looked up once, so a
    place or bin of many points is no longer work than another. Sorted passes, one up and one
    down, run over the places of one bin at a time; what lies in other bins comes from a table
    of each bin's first and last target.
    """
    t = targets.select("chrom", "pos").distinct().withColumn("bin", F.floor(F.col("pos") / size))
    p = points.select("chrom", "pos").distinct().withColumn("bin", F.floor(F.col("pos") / size))
    both = p.select("chrom", "pos", "bin", F.lit(None).cast("long").alias("t")).union(t.select("chrom", "pos", "bin", F.col("pos").alias("t")))
    w = W.partitionBy("chrom", "bin")
    # frames that end behind the row are summed anew for each row, so both begin at the border
    up, down = (w.orderBy(o).rangeBetween(W.unboundedPreceding, 0) for o in (F.col("pos").asc(), F.col("pos").desc()))
    inside = both.withColumn("below", F.max("t").over(up)).withColumn("above", F.min("t").over(down)).filter("t is null").drop("t")
    ends = p.select("chrom", "bin").distinct().join(t.groupBy("chrom", "bin").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")), ["chrom", "bin"], "full")
    v = W.partitionBy("chrom")
    carry = ends.select("chrom", "bin", F.max("hi").over(v.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)).alias("hi"), F.min("lo").over(v.orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, -1)).alias("lo"))
    out = inside.join(carry, ["chrom", "bin"]).withColumns({"below": F.coalesce("below", "hi"), "above": F.coalesce("above", "lo")})
    near = F.when(F.col("above").isNull() | (F.col("pos") - F.col("below") <= F.col("above") - F.col("pos")), F.col("below")).otherwise(F.col("above"))
    found = out.select("chrom", "pos", (near - F.col("pos")).alias("distance"))
    return points.select("id", "chrom", "pos").join(found, ["chrom", "pos"]).select("id", "chrom", "pos", "distance")


#: Sorted passes along a chromosome go by bins of so many places.
STRIPE = 1 << 16


def merged(df: DataFrame, keys: list[str], size: int = STRIPE) -> DataFrame:
    """Islands of overlapping or touching intervals of the same keys, with their best row's score and id.

    Rows are sorted in bins of size; how far the bins before reach, and where their last island starts, comes from tables of a row a bin.
    """
    w, bins = W.partitionBy(*keys, "_b").orderBy("start", "end", "id"), W.partitionBy(*keys).orderBy("_b")
    earlier = bins.rowsBetween(W.unboundedPreceding, -1)
    b = df.withColumn("_b", F.floor(F.col("start") / size))
    reach = b.groupBy(*keys, "_b").agg(F.max("end").alias("_r")).withColumn("_r", F.max("_r").over(earlier))
    inside = joined(b.withColumn("_i", F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))), reach, [*keys, "_b"])
    first = inside.withColumn("_f", F.when(F.coalesce(F.greatest("_i", "_r") < F.col("start"), F.lit(True)), F.col("start"))).drop("_i", "_r")
    last = first.groupBy(*keys, "_b").agg(F.max("_f").alias("_l")).withColumn("_l", F.max("_l").over(earlier))
    island = F.coalesce(F.max("_f").over(w.rowsBetween(W.unboundedPreceding, 0)), F.col("_l"))
    best = F.max(F.struct("score", (-F.col("id")).alias("i")))
    rows = joined(first, last, [*keys, "_b"]).withColumn("_island", island)
    return rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), best["score"].alias("best_score"), (-best["i"]).alias("best_id")).drop("_island")


def resolved(df: DataFrame, size: int = STRIPE) -> DataFrame:
    """Overlaps of equal-width windows split half-way: each piece ends at the middle between its centre and the next one's, and starts where the piece before ended. Pieces without length go."""
    cut = df.withColumn("_m", F.floor((F.col("start") + F.col("end")) / 2))
    cut = beside(cut, ["chrom"], F.struct(F.col("start").alias("s"), F.col("_m").alias("m")), "_next", size, after=True)
    cut = cut.withColumn("piece_end", F.when(F.col("_next.s") < F.col("end"), F.floor((F.col("_m") + F.col("_next.m")) / 2)).otherwise(F.col("end")))
    out = beside(cut, ["chrom"], F.col("piece_end"), "_last", size, after=False).withColumn("piece_start", F.greatest("start", F.coalesce("_last", "start")))
    return out.filter("piece_end > piece_start").drop("_m", "_next", "_last")


def tiles(sizes: DataFrame, width: int, stride: int) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(stride).cast("long")))
    return sizes.select("chrom", at.alias("start"), "size").select("chrom", "start", F.least(F.col("start") + width, F.col("size")).alias("end"))
