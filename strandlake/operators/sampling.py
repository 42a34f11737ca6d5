"""Deterministic sampling and matching: order by a hash of the key and a seed, never by rand()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .keys import joined


def draw(key: str, seed: int) -> Column:
    """A number between 0 and 2^32 that any engine can compute."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")).cast("binary")), 1, 8), 16, 10).cast("long")


def count_of(n: int | DataFrame, like: DataFrame) -> DataFrame:
    """A row with n, which may be such a row already."""
    return n if isinstance(n, DataFrame) else like.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"))


def first_drawn(df: DataFrame, key: str, n: int | DataFrame, seed: int = 1, whole: bool = False) -> DataFrame:
    """The n rows (a number, or a row with n, maybe null) of the least draws, of equal draws those of the least keys; with whole, an error where there are fewer.

    No task sorts or holds the rows. A histogram of the draws' upper half tells in which of
    65,536 ranges the border lies, one of the lower half of the draws in that range at which
    draw; rows below it are taken as they are read, and only those of just that draw are
    ranked. All of it is one query, which starts no job when it is made.
    """
    drawn = df.withColumn("_d", draw(key, seed))
    limit = count_of(n, df)
    everything = F.lit((1 << 16) - 1)

    def border(counts: DataFrame, want: DataFrame) -> DataFrame:
        """counts (_r, _c; 65,536 rows at most), want (n): the range in which the n-th row lies, and how many come before it; no row if there are fewer."""
        upto = counts.withColumn("_to", F.sum("_c").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, 0)))
        return upto.join(F.broadcast(want)).filter((F.col("_to") >= F.col("n")) & (F.col("_to") - F.col("_c") < F.col("n"))).select(F.col("_r"), (F.col("n") - F.col("_to") + F.col("_c")).alias("n"))

    ranges = drawn.groupBy(F.shiftright("_d", 16).alias("_r")).agg(F.count("*").alias("_c"))
    if whole:
        total = ranges.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_all"))
        enough = F.when(F.col("n") <= F.col("_all"), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("fewer rows to draw from than "), F.col("n").cast("string"))).cast("long"))
        limit = limit.join(F.broadcast(total)).select(enough.alias("n"))
    high = border(ranges, limit)
    inside = drawn.join(F.broadcast(high.select(F.col("_r").alias("_h"))), F.shiftright("_d", 16) == F.col("_h"))
    low = border(inside.groupBy(F.col("_d").bitwiseAND(everything).alias("_r")).agg(F.count("*").alias("_c")), high.select("n"))
    cut = limit.select(F.col("n").alias("_n")).join(F.broadcast(high.select(F.col("_r").alias("_h"))), how="left").join(F.broadcast(low.select(F.col("_r").alias("_l"), F.col("n").alias("_ties"))), how="left")
    # without a border: all rows, or none for 0 and less
    at = F.coalesce(F.shiftleft("_h", 16) + F.col("_l"), F.when(F.col("_n") > 0, F.lit(1 << 32)).otherwise(F.lit(-1)))
    met = drawn.join(F.broadcast(cut.select(at.cast("long").alias("_at"), "_ties")))
    below = met.filter("_d < _at").drop("_d", "_at", "_ties")
    k = F.row_number().over(W.partitionBy("_d").orderBy(key))
    tied = met.filter("_d = _at").withColumn("_k", k).filter("_k <= _ties").drop("_d", "_at", "_ties", "_k")
    return below.unionByName(tied)


def sample(df: DataFrame, key: str, n: int | DataFrame, seed: int = 1) -> DataFrame:
    """n rows without replacement (all, if there are fewer), in no order."""
    return first_drawn(df, key, n, seed)


def sample_ratio(df: DataFrame, key: str, foreground: int | DataFrame, ratio: float, seed: int = 1) -> DataFrame:
    """floor(foreground * ratio) rows; an error if there aren't as many: for rows to count, when the query runs, for a number, at once, by a job."""
    if isinstance(foreground, DataFrame):
        return first_drawn(df, key, foreground.agg(F.floor(F.count("*") * F.lit(ratio)).alias("n")), seed, whole=True)
    n = int(foreground * ratio)
    if df.agg(F.count("*")).first()[0] < n:
        raise ValueError(f"fewer than {n} rows to draw from")
    return first_drawn(df, key, n, seed)


def per_stratum(df: DataFrame, stratum: str, key: str, k: int, seed: int = 1) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(stratum).orderBy(draw(key, seed), key))).filter(F.col("_n") <= k).drop("_n")


def jittered(df: DataFrame, key: str, reach: int, epoch: int) -> DataFrame:
    return df.withColumn("jitter", F.when(F.col("weight") != 0, draw(key, epoch) % (2 * reach + 1) - reach).otherwise(0).cast("long"))


def batches(df: DataFrame, key: str, size: int, epoch: int, drop_rest: bool = False) -> DataFrame:
    """Rows numbered into batches in an order drawn for the epoch.

    Ranks are counted within 4096 ranges of the drawn number and shifted by the rows of
    the ranges before, so no single task orders all rows.
    """
    ranged = df.withColumn("_d", draw(key, epoch)).withColumn("_r", F.shiftright("_d", 20))
    before = ranged.groupBy("_r").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    rank = F.row_number().over(W.partitionBy("_r").orderBy("_d", key)) - 1
    out = ranged.withColumn("_n", rank).join(F.broadcast(before), "_r").withColumn("batch_id", F.floor((F.col("_n") + F.col("_before")) / size))
    if drop_rest:
        out = out.filter(F.col("batch_id") < F.lit(df.count() // size))
    return out.drop("_n", "_d", "_r", "_before")


def ranked(df: DataFrame, by: list[str], name: str, seed: int = 1, key: str = "id", ranges: int = 12) -> DataFrame:
    """df with each row's number from 0 within its keys by, in drawn order.

    Rows are sorted within ranges of the draw, 2^ranges a group, and shifted by the rows of the
    ranges before, so a group that holds most rows is many tasks.
    """
    r = df.withColumn("_d", draw(key, seed)).withColumn("_r", F.shiftright("_d", 32 - ranges))
    before = r.groupBy(*by, "_r").agg(F.count("*").alias("_c")).withColumn("_before", F.sum("_c").over(W.partitionBy(*by).orderBy("_r").rowsBetween(W.unboundedPreceding, -1))).drop("_c")
    inside = r.withColumn("_i", F.row_number().over(W.partitionBy(*by, "_r").orderBy("_d", key)) - 1)
    return joined(inside, before, [*by, "_r"]).withColumn(name, (F.col("_i") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_d", "_r", "_i", "_before")


def matched(positives: DataFrame, candidates: DataFrame, by: list[str], ratio: int = 1, seed: int = 1) -> DataFrame:
    """For each positive, ratio candidates of equal keys, none twice: the k-th positives take the k-th candidates in drawn orders."""
    p = ranked(positives, by, "_k", seed).select(*by, F.col("id").alias("positive_id"), F.explode(F.sequence(F.col("_k") * ratio, (F.col("_k") + 1) * ratio - 1)).alias("_k"))
    c = ranked(candidates, by, "_k", seed).select(*by, F.col("id").alias("candidate_id"), "_k")
    return p.join(c, [*by, "_k"]).drop("_k")


#: Ranks of a group are joined to the steps that use them in blocks of so many.
RANKS = 1 << 12


def matched_nearby(positives: DataFrame, candidates: DataFrame, group: str, value: str, reach: int | None = None, seed: int = 1, ratio: int = 1, bounds: tuple[int, int] | None = None, drawn: bool = False) -> DataFrame:
    """matched() by group and value, then, for those without a match, at values 1, -1, 2, -2 and so on away; without reach, until no positive is left or the group's candidates run out.

    With bounds, a step that would leave them bounces back inside, so candidates beyond them
    serve positives of their own value alone; with drawn, the seed decides for each group and
    distance whether up or down comes first.

    Which ranks meet at which step follows from the numbers of rows by value alone, so the
    steps are walked over these, a group in one task, and rows are joined once, by rank: no
    task holds a value's rows.
    """
    import hashlib

    kind, unit = (positives.schema[c].dataType.simpleString() for c in (group, value))

    def steps(name, farthest: int):
        yield 0
        for d in range(1, farthest + 1):
            down = drawn and hashlib.md5(f"{name}/{d}/{seed}".encode()).digest()[0] & 1
            yield from (-d, d) if down else (d, -d)

    def walk(numbers):
        import pyarrow as pa

        left = [{}, {}]
        name = numbers.column(group)[0].as_py()
        for x, side, n in zip(*(numbers.column(c).to_pylist() for c in (value, "_side", "_n")), strict=True):
            left[side][x] = n
        p, c = left
        used, out = [dict.fromkeys(p, 0), dict.fromkeys(c, 0)], []
        farthest = max(abs(a - b) for a in (min(p), max(p)) for b in (min(c), max(c))) if p and c else -1
        for step in steps(name, farthest if reach is None else min(farthest, reach)) if farthest >= 0 else ():
            if not p or not c:
                break
            for x in list(p):
                to = x + step
                if step and bounds:
                    span = max(1, bounds[1] - bounds[0])
                    to = bounds[0] + abs((to - bounds[0] + span) % (2 * span) - span)
                if n := min(p[x], c.get(to, 0)):
                    out.append((name, x, used[0][x], n, to, used[1][to], to - x))
                    for rest, taken, at in ((p, used[0], x), (c, used[1], to)):
                        taken[at] += n
                        rest[at] -= n
                        if not rest[at]:
                            del rest[at]
        columns = zip(*out, strict=True) if out else [[]] * 7
        return pa.table([pa.array(col, f.type) for col, f in zip(columns, arrow, strict=True)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(f"`{group}` {kind}, _p {unit}, _from long, _n long, `{value}` {unit}, _to long, step int")
    arrow = to_arrow_schema(fields)
    sides = [x.filter(F.col(value).isNotNull()).groupBy(group, value).agg((F.count("*") * times).alias("_n")).withColumn("_side", F.lit(side)) for side, x, times in ((0, positives, ratio), (1, candidates, 1))]
    plan = sides[0].unionByName(sides[1]).groupBy(group).applyInArrow(walk, fields)
    block = F.floor(F.col("_k") / RANKS).alias("_block")
    p = ranked(positives.select("id", group, value), [group, value], "_k", seed).select(group, F.col(value).alias("_p"), F.col("id").alias("positive_id"), F.explode(F.sequence(F.col("_k") * ratio, (F.col("_k") + 1) * ratio - 1)).alias("_k"))
    c = ranked(candidates.select("id", group, value), [group, value], "_k", seed).select(group, value, F.col("id").alias("candidate_id"), F.col("_k"))
    plan = plan.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / RANKS), F.floor((F.col("_from") + F.col("_n") - 1) / RANKS))))
    units = p.select("*", block).join(plan, [group, "_p", "_block"]).filter((F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_from") + F.col("_n")))
    units = units.select(group, value, "positive_id", (F.col("_k") - F.col("_from") + F.col("_to")).cast("long").alias("_k"), "step")
    return units.join(c, [group, value, "_k"]).select(group, value, "positive_id", "candidate_id", "step")


def numbered(df: DataFrame, key: str, name: str, width: int = 1 << 16) -> DataFrame:
    """df with its rows' numbers from 0 in the order of an integer key without repeats, counted within ranges of width and shifted."""
    ranged = df.withColumn("_r", F.floor(F.col(key) / width))
    before = ranged.groupBy("_r").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    rank = F.row_number().over(W.partitionBy("_r").orderBy(key)) - 1
    return ranged.withColumn("_n", rank).join(before, "_r").withColumn(name, F.col("_n") + F.col("_before")).drop("_n", "_r", "_before")


def by_index(df: DataFrame, key: str, index: DataFrame, chroms: list[str] | None = None) -> DataFrame:
    """Rows whose number in the order of key is in index (row_idx); chroms, where given, take precedence over the index."""
    if chroms is not None:
        return df.filter(F.col("chrom").isin(chroms))
    return numbered(df, key, "row_idx").join(index.select("row_idx").distinct(), "row_idx", "left_semi")


def batch_plan(rows: int, batch: int, threads: int) -> tuple[int, int, int]:
    """How many rows, in which batches, on how many threads: the batch is halved, then threads go, until a whole batch for each thread fits."""
    while rows < batch * threads and batch * threads > 1:
        batch, threads = (batch // 2, threads) if batch > 1 else (1, threads - 1)
    if rows < batch * threads:
        raise ValueError("too few rows for a batch")
    return rows - rows % (batch * threads), batch, threads


def planned_rows(rows: Column, batch: int, threads: int) -> Column:
    """batch_plan()'s number of rows for a number of rows that only the query knows."""
    sizes = []
    while batch * threads > 1:
        sizes.append(batch * threads)
        batch, threads = (batch // 2, threads) if batch > 1 else (1, threads - 1)
    out = F.when(rows >= 1, rows).otherwise(F.raise_error(F.lit("too few rows for a batch")).cast("long"))
    for size in reversed(sizes):
        out = F.when(rows >= size, rows - rows % size).otherwise(out)
    return out


def whole_batches(df: DataFrame, key: str, batch: int, threads: int, seed: int = 1) -> DataFrame:
    """A seeded sample of as many rows as fill batches on all threads alike."""
    return first_drawn(df, key, df.agg(planned_rows(F.count("*"), batch, threads).alias("n")), seed)
