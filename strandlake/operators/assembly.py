"""Examples from genome and tracks: sequences by range, dense windows, both strands, and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as sq
from . import sampling
from .keys import placed
from .tracks import dense  # noqa: F401 (windows of tracks are part of examples)


def fetched(loci: DataFrame, chunks: DataFrame, size: int, beyond: str = "pad") -> DataFrame:
    """loci (id, chrom, start, end, ...; start not negative) with seq, upper case, from chunks (chrom, chunk_id, start, seq) of size letters.

    A locus meets the chunks that it touches only. Places beyond the contig are N, or an
    error where beyond is 'error' and no letter is there.
    """
    touched = loci.select("id", "chrom", F.col("start").alias("_a"), F.col("end").alias("_b"), F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.greatest("start", F.col("end") - 1)) / size))).alias("chunk_id"))
    piece = F.expr(f"substring(seq, cast(greatest(_a - start, 0) as int) + 1, cast(least(_b - start, {size}) - greatest(_a - start, 0) as int))")
    parts = touched.join(chunks.select("chrom", "chunk_id", "start", "seq"), ["chrom", "chunk_id"]).select("id", F.struct("start", piece.alias("s")).alias("p"))
    whole = parts.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "").alias("_s"))
    out = loci.join(whole.hint("merge"), "id", "left")  # windows are no table to broadcast, whatever the planner takes them for
    n = (F.col("end") - F.col("start")).cast("int")
    found = F.upper(F.coalesce("_s", F.lit("")))
    if beyond == "error":
        found = F.when(F.length(found) == n, found).otherwise(F.raise_error(F.concat(F.lit("out of range: "), F.col("id").cast("string"))))
    return out.withColumn("seq", F.rpad(found, n, "N")).drop("_s")


def both_strands(examples: DataFrame) -> DataFrame:
    """examples (..., seq, plus, minus) and their reverse complements, marked by rev_comp: letters complemented, profiles flipped and exchanged."""
    other = examples.withColumns({"seq": sq.reverse_complement(F.col("seq")), "plus": F.reverse("minus"), "minus": F.reverse("plus"), "rev_comp": F.lit(1)})
    return examples.withColumn("rev_comp", F.lit(0)).unionByName(other)


def bias_tracks(sources: Column, smoothings: Column) -> Column:
    """How many bias tracks a task gives: each source, and one more for each smoothing that isn't null; an error where there aren't as many smoothings as sources."""
    n = F.size(sources)
    return F.when(n == 0, 0).when(n != F.size(smoothings), F.raise_error(F.lit("a smoothing for each source, null for none")).cast("int")).otherwise(n + F.size(F.filter(smoothings, lambda x: x.isNotNull())))


def mean_over_tracks(sums: DataFrame) -> DataFrame:
    """sums (id, track, total) -> id and the mean of its tracks."""
    return sums.groupBy("id").agg(F.avg("total").alias("mean"))


def loss_weight(sums: DataFrame, alpha: float = 1.0, original: bool = False) -> DataFrame:
    """weight, n: alpha (half of it for the original loss) times the mean total over all pairs of track and peak of sums."""
    return sums.agg((F.lit(alpha / 2 if original else alpha) * F.avg("total")).alias("weight"), F.count("*").alias("n"))


def random_positions(sizes: DataFrame, n: int, width: int, seed: int = 1) -> DataFrame:
    """n windows of a width drawn evenly over the places where they fit; sizes has one row a chromosome."""
    from pyspark.sql import Window as W

    room = sizes.filter(F.col("size") >= width).withColumn("_n", F.col("size") - width + 1)
    ends = room.withColumn("_to", F.sum("_n").over(W.orderBy("chrom"))).withColumn("_from", F.col("_to") - F.col("_n"))
    total = room.agg(F.sum("_n")).first()[0] or 0
    if not total:
        raise ValueError("no chromosome is as long as the windows")
    ids = sizes.sparkSession.range(n)
    at = ids.withColumn("_at", (sampling.draw("id", seed) * F.lit(1 << 20) + sampling.draw("id", seed + 1) % (1 << 20)) % total)
    return at.join(F.broadcast(ends), (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))).select("id", "chrom", (F.col("_at") - F.col("_from")).alias("start"), (F.col("_at") - F.col("_from") + width).alias("end"))


def sequential_positions(sizes: DataFrame, width: int, stride: int) -> DataFrame:
    """chrom, start, end: windows of a width at each stride that lie wholly on their chromosome."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("size") - width).cast("long"), F.lit(stride).cast("long"))).alias("start")
    return sizes.filter(F.col("size") >= width).select("chrom", at).withColumn("end", F.col("start") + width)


ORDERS = {"end": ("chrom", "end", "start"), "signal": ("-signal", "chrom", "start")}


def numbered(loci: DataFrame, how: str = "end") -> DataFrame:
    """ordered() by 'end' or 'signal' as a column: place, from 0; id decides where the order doesn't."""
    columns = [F.col(c[1:]).desc() if c[0] == "-" else F.col(c).asc() for c in (*ORDERS[how], "id")]
    return placed(loci, columns, "place")


def ordered(loci: DataFrame, how: str = "end", order: DataFrame | None = None) -> DataFrame:
    """Loci sorted by (chrom, end), by falling signal, by an outer order of chromosomes (chrom, place), or by their coordinates as text."""
    if how == "end":
        return loci.orderBy("chrom", "end", "start")
    if how == "signal":
        return loci.orderBy(F.col("signal").desc(), "chrom", "start")
    if how == "text":
        return loci.withColumn("coordinates", F.concat_ws("_", "chrom", "start", "end")).orderBy("coordinates")
    return loci.join(F.broadcast(order.select("chrom", "place")), "chrom").orderBy("place", "start", "end")  # a row a chromosome
