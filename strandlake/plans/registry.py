"""Registered queries and their DuckDB SQL: one for each operator or family."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import profile as pf
from ..functions import sequence as sq
from ..operators import intervals as iv
from ..operators import genome, motifs, sampling, scoring, stats, tracks
from ..operators.tables import stored
from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
C = F.col


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = v.with_views(sql, *views)
        return f

    return add


def windows(s: SparkSession, d: str) -> DataFrame:
    return iv.in_bounds(iv.centred(v.loci(s, d), 60), F.broadcast(v.sizes(s, d))).select("id", "chrom", "start", "end", "signal")


def lohi(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"start": "lo", "end": "hi"})


OUTLIER_SQL = """
with good as (select * from windows w where not exists (select 1 from regions b where b.chrom = w.chrom and ((b_start <= lo and b_end >= lo) or (b_start <= hi and b_end >= hi)))),
sums as (select g.id, g.chrom, g.lo, g.hi, coalesce(sum(t.value), 0)::bigint as total from good g left join track t on t.chrom = g.chrom and t.lo < g.hi and g.lo < t.hi group by all),
q as (select quantile_cont(total, 0.9) as q from sums),
near as (select total as near from sums, q order by abs(total - q), total limit 1)
select id, chrom, lo, hi, total from sums, near where total <= near * 1.2
"""


@query(OUTLIER_SQL, "windows", "regions", "track")
def outlier_filter(s, d):
    good = iv.without_blacklisted(windows(s, d), v.regions(s, d), v.BIN)
    sums = iv.coverage_sums(good.select("id", "chrom", "start", "end"), v.track(s, d), v.BIN, ["id", "chrom", "start", "end"])
    return lohi(stats.quantile_trim(sums, "total", 0.9, 1.2))


@query("select id, chrom, lo, hi from windows", "windows")
def recentred_windows(s, d):
    return lohi(windows(s, d).drop("signal"))


@query("select id, chrom, lo, hi from windows w where not exists (select 1 from regions b where b.chrom = w.chrom and lo < b_end and b_start < hi)", "windows", "regions")
def blacklist_by_overlap(s, d):
    return lohi(iv.without_blacklisted(windows(s, d), v.regions(s, d), v.BIN, "overlap").drop("signal"))


@query("with t as (select chrom, g as lo, least(g + 40, size) as hi from (select chrom, size, unnest(generate_series(0, size - 1, 20)) as g from sizes)) select * from t where not exists (select 1 from points p where p.chrom = t.chrom and p.pos - 5 < t.hi and t.lo < p.pos + 5)", "sizes", "points")
def candidate_negatives(s, d):
    peaks = v.loci(s, d).select("chrom", C("st").alias("b_start"), C("e").alias("b_end")).distinct()
    return lohi(iv.overlap_join(iv.tiles(v.sizes(s, d), 40, 20), peaks, v.BIN, how="left_anti"))


@query("select chrom, g as lo, least(g + 50, size) as hi from (select chrom, size, unnest(generate_series(0, size - 1, 30)) as g from sizes)", "sizes")
def genome_tiles(s, d):
    return lohi(iv.tiles(v.sizes(s, d), 50, 30))


@query("select l.id, l.chrom, st as lo, e as hi, region from loci l join regions b on b.chrom = l.chrom and st >= b_start and e <= b_end", "loci", "regions")
def hits_inside_regions(s, d):
    inner = v.loci(s, d).select("id", "chrom", C("st").alias("start"), C("e").alias("end"))
    return lohi(iv.contained(inner, v.regions(s, d), v.BIN).drop("b_start", "b_end"))


@query("with o as (select l.id, region, row_number() over (partition by l.id order by b_start, region) as k from loci l join regions b on b.chrom = l.chrom and st >= b_start and e <= b_end) select id, region from o where k = 1", "loci", "regions")
def first_containing_region(s, d):
    inner = v.loci(s, d).select("id", "chrom", C("st").alias("start"), C("e").alias("end"))
    pairs = iv.contained(inner, v.regions(s, d), v.BIN)
    return pairs.groupBy("id").agg(F.min_by("region", F.struct("b_start", "region")).alias("region"))


@query("""with t as (select distinct chrom, b_start as pos from regions),
r as (select p.id, p.chrom, p.pos, t.pos - p.pos as distance, row_number() over (partition by p.id order by abs(t.pos - p.pos), t.pos) as k from points p join t on t.chrom = p.chrom)
select id, chrom, pos, distance from r where k = 1""", "points", "regions")
def nearest_summit(s, d):
    return iv.nearest(v.points(s, d).select("id", "chrom", "pos"), v.regions(s, d).select("chrom", C("b_start").alias("pos")), 1024)


@query("""with o as (select *, max(hi) over (partition by key order by lo, hi, id rows between unbounded preceding and 1 preceding) as before from hits),
i as (select *, sum(case when before >= lo then 0 else 1 end) over (partition by key order by lo, hi, id rows unbounded preceding) as island from o)
select key, min(lo) as lo, max(hi) as hi, count(*) as n, max(score) as best_score, (list(id order by score desc, id))[1] as best_id from i group by key, island""", "hits")
def merged_hits(s, d):
    return lohi(iv.merged(v.hits(s, d), ["key"]))


@query("""with o as (select *, (lo + hi) // 2 as m, lead(lo) over w as ns, lead((lo + hi) // 2) over w as nm from windows window w as (partition by chrom order by lo, id)),
c as (select *, case when ns < hi then (m + nm) // 2 else hi end as piece_end from o),
p as (select id, chrom, lo, hi, greatest(lo, coalesce(lag(piece_end) over (partition by chrom order by lo, id), lo)) as piece_start, piece_end from c)
select * from p where piece_end > piece_start""", "windows")
def resolved_overlaps(s, d):
    return lohi(iv.resolved(windows(s, d).drop("signal")))


@query("select w.id, coalesce(sum(t.value), 0)::bigint as total, round(ln(coalesce(sum(t.value), 0) + 1), 6) as log_total from windows w left join track t on t.chrom = w.chrom and t.lo < w.hi and w.lo < t.hi group by w.id", "windows", "track")
def signal_per_locus(s, d):
    sums = iv.coverage_sums(windows(s, d).select("id", "chrom", "start", "end"), v.track(s, d), v.BIN, ["id", "chrom", "start", "end"])
    return sums.select("id", "total", F.round(F.log1p("total"), 6).alias("log_total"))


@query("select id, w.lo + offs as pos, coalesce(t.value, 0)::bigint as value from (select id, chrom, lo, unnest(generate_series(0, 119)) as offs from windows) w left join track t on t.chrom = w.chrom and t.lo = w.lo + w.offs", "windows", "track")
def dense_extraction(s, d):
    """By cells that are made where a locus meets a short chunk."""
    x = tracks.cells(windows(s, d).select("id", "chrom", "start", "end"), v.track(s, d), 1024)
    return x.select("id", "pos", C("value").cast("long").alias("value"))


@query("select round(5 * avg(total), 6) as weight, count(*) as n from (select w.id, coalesce(sum(t.value), 0) as total from windows w left join track t on t.chrom = w.chrom and t.lo < w.hi and w.lo < t.hi group by w.id)", "windows", "track")
def counts_loss_weight(s, d):
    sums = iv.coverage_sums(windows(s, d).select("id", "chrom", "start", "end"), v.track(s, d), v.BIN, ["id", "chrom", "start", "end"])
    return sums.agg(F.round(5 * F.avg("total"), 6).alias("weight"), F.count("*").alias("n"))


@query("select min(value) as lo, round(quantile_cont(value, 0.001), 6) as q001, round(quantile_cont(value, 0.01), 6) as q01, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.99), 6) as q99, round(quantile_cont(value, 0.999), 6) as q999, round(quantile_cont(value, 0.9995), 6) as q9995, round(quantile_cont(value, 0.9999), 6) as q9999, max(value) as hi from track", "track")
def track_statistics(s, d):
    names = {"q001": 0.001, "q01": 0.01, "q50": 0.5, "q99": 0.99, "q999": 0.999, "q9995": 0.9995, "q9999": 0.9999}
    track = v.track(s, d)
    ends = track.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return ends.join(stats.quantiles(track, "value", [], names)).select("lo", *(F.round(n, 6).alias(n) for n in names), "hi")


@query("select chrom, round(n * 1.0 / sum(n) over (), 6) as share from (select chrom, count(*) as n from track group by chrom)", "track")
def chrom_share(s, d):
    n = v.track(s, d).groupBy("chrom").agg(F.count("*").alias("n"))
    return n.select("chrom", F.round(C("n") / F.sum("n").over(W.partitionBy()), 6).alias("share"))


@query("select id, case when signal = 0 then 0 else 1 end as weight, case when signal = 0 then -1 else 1 end as status, greatest(st, 0) as lo, least(e, 43200) as hi from loci where chrom in ('click', 'view', 'purchase')", "loci")
def status_and_clamp(s, d):
    x = v.loci(s, d).filter(C("chrom").isin("click", "view", "purchase")).withColumn("weight", F.when(C("signal") == 0, 0).otherwise(1))
    return x.select("id", "weight", F.when(C("weight") == 0, -1).otherwise(1).alias("status"), F.greatest("st", F.lit(0)).alias("lo"), F.least("e", F.lit(v.MINUTES)).alias("hi"))


SEQ_SQL = """
select id, translate(reverse(seq), 'ACGT', 'TGCA') as rc, left(rpad(seq, 50, 'N'), 50) as fixed, length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')) as gc,
case when length(seq) = 0 then null else (200 * (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) + length(seq)) // (2 * length(seq)) end::double as gc_pct,
regexp_full_match(seq, '[ACGT]+') as clean, 2 * length(replace(replace(seq, 'C', ''), 'T', '')) > length(seq) as purine, left(rpad(seq, 50, 'N'), 50)[21:30] as mid, length(seq) - length(seq) % 64 as whole from sequences
"""


@query(SEQ_SQL, "sequences")
def sequence_functions(s, d):
    q = C("seq")
    n = F.length(q)
    return v.sequences(s, d).select(
        "id", sq.reverse_complement(q).alias("rc"), sq.fixed_length(q, 50).alias("fixed"), sq.base_count(q, "GC").cast("long").alias("gc"), sq.gc_percent(q).cast("double").alias("gc_pct"),
        sq.only_acgt(q).alias("clean"), sq.purine_forward(q).alias("purine"), sq.centre(sq.fixed_length(q, 50), 10).alias("mid"), sq.round_to_multiple(n, 64).cast("long").alias("whole"),
    )


def letters_of(sequences: DataFrame, *keys) -> DataFrame:
    """pos and base of every letter of whole sequences."""
    return sequences.filter(F.length("seq") > 0).select(*keys, F.posexplode(F.split("seq", "")).alias("pos", "base")).withColumn("pos", C("pos").cast("long"))


def information(letters: DataFrame, *keys) -> DataFrame:
    p = letters.groupBy(*keys, "pos").agg(*(F.avg((C("base") == b).cast("double")).alias(b) for b in "ACGT"))
    return p.select(*keys, "pos", F.round(pf.information_content([C(b) for b in "ACGT"]), 6).alias("ic"))


LETTERS = "select id, unnest(generate_series(0, length(seq) - 1)) as pos, unnest(string_split(seq, '')) as base from sequences where length(seq) > 0"


@query("select id, seq as back, (length(seq) - length(replace(seq, 'A', '')))::bigint as n_a from sequences", "sequences")
def one_hot_round_trip(s, d):
    x = v.sequences(s, d).withColumn("hot", F.when(F.length("seq") > 0, sq.one_hot(C("seq"))).otherwise(F.array().cast("array<array<int>>")))
    return x.select("id", sq.from_one_hot(C("hot")).alias("back"), F.aggregate("hot", F.lit(0), lambda a, r: a + r[0]).cast("long").alias("n_a"))


@query(f"select pos, base, count(*) as n from ({LETTERS}) group by all", "sequences")
def position_counts(s, d):
    return letters_of(v.sequences(s, d)).groupBy("pos", "base").agg(F.count("*").alias("n"))


@query(f"""with c as (select pos, base, count(*) as n from ({LETTERS}) group by all),
f as (select pos, base, n / sum(n) over (partition by pos) as p from c)
select pos, round(sum((p + 0.001) / 1.004 * log2((p + 0.001) / 1.004 / 0.25)) + (4 - count(*)) * 0.001 / 1.004 * log2(0.001 / 1.004 / 0.25), 6) as ic from f group by pos""", "sequences")
def information_content(s, d):
    return information(letters_of(v.sequences(s, d)))


@query("select distinct chrom, lo, hi from (select chrom, lo, hi from windows union all select chrom, lo, hi from windows)", "windows")
def union_distinct(s, d):
    w = lohi(windows(s, d)).select("chrom", "lo", "hi")
    return w.unionByName(w).dropDuplicates()


@query("(select distinct chrom, pos // 60 as h from points except select chrom, b_start // 60 from regions) union all (select distinct chrom, pos // 60 + 100000 as h from points intersect select chrom, b_start // 60 + 100000 from regions)", "points", "regions")
def set_operations(s, d):
    a = v.points(s, d).select("chrom", F.floor(C("pos") / 60).alias("h")).distinct()
    b = v.regions(s, d).select("chrom", F.floor(C("b_start") / 60).alias("h"))
    return a.subtract(b).union(a.intersect(b).select("chrom", C("h") + 100000))


@query("with r as (select chrom, pos, id, row_number() over (partition by chrom, pos order by id desc) as k from points) select chrom, pos, id from r where k = 1", "points")
def last_duplicate_wins(s, d):
    return v.points(s, d).groupBy("chrom", "pos").agg(F.max("id").alias("id"))


@query("with r as (select chrom, id, signal, row_number() over (partition by chrom order by signal desc, id) as k from loci) select chrom, id, signal, k from r where k <= 5", "loci")
def top_k_per_group(s, d):
    k = F.row_number().over(W.partitionBy("chrom").orderBy(C("signal").desc(), "id"))
    return v.loci(s, d).select("chrom", "id", "signal", k.cast("long").alias("k")).filter("k <= 5")


DRAW = "('0x' || left(md5(id::varchar || '/{}'), 8))::bigint"


@query(f"select * from points order by {DRAW.format(1)}, id limit 100", "points")
def seeded_sample(s, d):
    return sampling.sample(v.points(s, d), "id", 100)


@query(f"select * exclude (k) from (select *, row_number() over (partition by chrom order by {DRAW.format(1)}, id) as k from points) where k <= 10", "points")
def sample_per_stratum(s, d):
    return sampling.per_stratum(v.points(s, d), "chrom", "id", 10)


@query(f"select *, (case when value > 0 then 1 else 0 end)::int as weight, case when value > 0 then {DRAW.format(3)} % 17 - 8 else 0 end as jitter, (row_number() over (order by {DRAW.format(3)}, id) - 1) // 64 as batch_id from points", "points")
def epoch_batches(s, d):
    return sampling.batches(sampling.jittered(v.points(s, d).withColumn("weight", F.when(C("value") > 0, 1).otherwise(0)), "id", 8, 3), "id", 64, 3)


@query()
def gc_matched(s, d):
    x = v.sequences(s, d).select("id", sq.gc_percent(C("seq")).alias("gc")).filter("gc is not null")
    pages = v.table(s, d, "pages").select(C("page_id").alias("id"), sq.gc_percent(F.upper(F.regexp_replace("html", "[^ACGTacgt]", ""))).alias("gc")).filter("gc is not null")
    x, pages = stored(x), stored(pages)  # texts are read once; counts and ranks go by numbers
    one = F.lit("all").alias("chrom")
    return sampling.matched_nearby(pages.select("id", one, "gc"), x.select("id", one, "gc"), "chrom", "gc")


@query("""with t as (select *, sum(a) over (partition by id) as sa, sum(b) over (partition by id) as sb, count(*) over (partition by id) as k from pairs),
m as (select id, a, b, k, a / sa as p, b / sb as q from t)
select id, round(-sum(p * ln(q + 1e-7)), 6) as ce, round(sum((a - b) * (a - b)) / max(k), 6) as mse,
round(sqrt(greatest(sum((case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end) + (case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end)) / 2, 0)), 6) as jsd from m group by id""", "pairs")
def profile_distances(s, d):
    x = v.arrays(s, d)
    return x.select("id", F.round(pf.cross_entropy(C("a"), pf.shares(C("b"))), 6).alias("ce"), F.round(pf.mean_square(C("a"), C("b")), 6).alias("mse"), F.round(pf.jensen_shannon(C("a"), C("b")), 6).alias("jsd"))


@query("""with t as (select *, b / sum(b) over (partition by id) as q from pairs)
select id, round(-(lgamma(sum(a) + 1) - sum(lgamma(a + 1)) + sum(case when a > 0 then a * ln(q) else 0 end)) / count(*), 6) as mnll from t group by id""", "pairs")
def multinomial_loss(s, d):
    x = v.arrays(s, d).select("id", pf.multinomial_nll_of_weights("a", "b").alias("mnll"))
    return x.select("id", F.round("mnll", 6).alias("mnll"))


@query("""with t as (select id, pos, n / 100.0 as x from profiles), m as (select id, max(x) as top, sum(exp(x)) as z from t group by id)
select id, round(max(exp(x) / z), 6) as top_share, round(min(exp(x) / z), 9) as least_share from t join m using (id) group by id""", "profiles")
def softmax_profiles(s, d):
    x = v.arrays(s, d).select("id", pf.softmax(F.transform("a", lambda y: y / 100.0)).alias("p"))
    return x.select("id", F.round(F.array_max("p"), 6).alias("top_share"), F.round(F.array_min("p"), 9).alias("least_share"))


@query("select id, round(case when hi = lo then 0 else least(1, greatest(0, (m - lo) / (hi - lo))) end, 6) as score from (select id, avg(n) as m, min(n) as lo, max(n) as hi from profiles group by id)", "profiles")
def normalised_scores(s, d):
    x = v.profiles(s, d).groupBy("id").agg(F.avg("n").alias("m"), F.min("n").cast("double").alias("lo"), F.max("n").cast("double").alias("hi"))
    return x.select("id", F.round(pf.min_max_normalised(C("m"), C("hi"), C("lo")), 6).alias("score"))


@query("""with r as (select id, rank() over (partition by id order by a) + (count(*) over (partition by id, a) - 1) / 2.0 as ra, rank() over (partition by id order by b) + (count(*) over (partition by id, b) - 1) / 2.0 as rb, a, b from pairs)
select id, round(coalesce(corr(ra, rb), 0), 6) as spearman, round(coalesce(corr(a, b), 0), 6) as pearson from r group by id""", "pairs")
def rank_correlations(s, d):
    long = v.arrays(s, d).select("id", F.explode(F.arrays_zip("a", "b")).alias("z")).select("id", "z.a", "z.b")
    p = long.groupBy("id").agg(F.round(stats.correlation("a", "b"), 6).alias("pearson"))
    return stats.spearman(long, "a", "b", ["id"]).select("id", F.round("spearman", 6).alias("spearman")).join(p, "id")


@query("select label, pos, round(avg(n), 6) as mean, min(n) as lo, max(n) as hi, round(stddev_pop(n), 6) as sd, round(median(n), 6) as mid from profiles group by label, pos", "profiles")
def mean_profiles(s, d):
    n = v.profiles(s, d).groupBy("label", "pos")
    return n.agg(F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.round(F.stddev_pop("n"), 6).alias("sd"), F.round(F.percentile("n", 0.5), 6).alias("mid"))


@query("""with e as (select label, min(n) as lo, max(n) as hi from profiles group by label), b as (select label, lo, hi, coalesce(least(floor((n - lo) / nullif((hi - lo) / 200.0, 0)), 199), 0) as bin, count(*) as k from profiles join e using (label) group by all),
r as (select *, row_number() over (partition by label order by k desc, bin) as rk from b)
select label, round(lo + (hi - lo) / 200.0 * (bin + 0.5), 6) as mode, k as n from r where rk = 1""", "profiles")
def histogram_modes(s, d):
    m = stats.histogram_mode(v.profiles(s, d).withColumn("n", C("n").cast("double")), "n", ["label"])
    return m.select("label", F.round("mode", 6).alias("mode"), "n")


@query("with q as (select label, quantile_cont(n, 0.25) as a, quantile_cont(n, 0.7) as b from profiles group by label) select label, count(*) as kept, sum(n)::bigint as total from profiles join q using (label) where n between a - 1.5 * (b - a) and b + 1.5 * (b - a) group by label", "profiles")
def clipped_outliers(s, d):
    return stats.iqr_clipped(v.profiles(s, d), "n", ["label"]).groupBy("label").agg(F.count("*").alias("kept"), F.sum("n").alias("total"))


@query("""with m as (select key, max(score) + 1.0 as top from hits group by key), p as (select id, key, exp(-20.0 * score / top) as p from hits join m using (key)),
r as (select *, row_number() over (partition by key order by p, id) as k, count(*) over (partition by key) as n from p),
c as (select *, max(case when p <= k / n::double * 0.2 then p end) over (partition by key) as cut from r)
select id, key, round(p, 9) as p from c where p <= cut""", "hits")
def false_discovery(s, d):
    h = v.hits(s, d)
    top = h.groupBy("key").agg((F.max("score") + 1.0).alias("top"))
    p = h.join(top, "key").select("id", "key", F.exp(-20.0 * C("score") / C("top")).alias("p"))
    return stats.benjamini_hochberg(p, "p", ["key"], 0.2).select("id", "key", F.round("p", 9).alias("p"))


HISTORY = "select (year(o_orderdate) * 12 + month(o_orderdate)) as epoch, (sum(floor(o_totalprice))::bigint // count(*)) as loss from orders group by 1"


@query(f"""with h as ({HISTORY}), l as (select epoch, loss, lag(loss, 3) over (order by epoch) as anchor, min(loss) over (order by epoch rows between 2 preceding and current row) as best, min(loss) over (order by epoch rows between unbounded preceding and 1 preceding) as before from h)
select epoch, loss, coalesce(best >= anchor - 100, false) as stop, before is null or loss < before as best_so_far from l""", "points")
def early_stopping(s, d):
    o = v.table(s, d, "orders").select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("epoch"), F.floor("o_totalprice").alias("x"))
    return stats.early_stop(o.groupBy("epoch").agg(F.floor(F.sum("x") / F.count("*")).alias("loss")), 3, 100)


@query("with n as (select peak, key, count(*) as n from hits group by all) select a.key as key_a, b.key as key_b, count(*) as peaks from n a join n b using (peak) where a.key <> b.key or a.n >= 2 group by all", "hits")
def motif_cooccurrence(s, d):
    return motifs.cooccurrence(v.hits(s, d))


@query("""with n as (select distinct peak, key from hits), c as (select key, count(*) as k from n group by key), t as (select count(distinct peak) as n from hits),
b as (select a.key as key_a, b.key as key_b, count(*) as k from n a join n b using (peak) where a.key < b.key group by all),
x as (select key_a, key_b, b.k as k, ca.k as ka, cb.k as kb, t.n from b join c ca on ca.key = key_a join c cb on cb.key = key_b, t)
select key_a, key_b, round(least(1, list_sum(list_transform(generate_series(greatest(k, ka + kb - n), least(ka, kb)), lambda i: exp(lgamma(ka + 1) - lgamma(i + 1) - lgamma(ka - i + 1) + lgamma(n - ka + 1) - lgamma(kb - i + 1) - lgamma(n - ka - kb + i + 1) - lgamma(n + 1) + lgamma(kb + 1) + lgamma(n - kb + 1))))), 6) as p from x""", "hits")
def cooccurrence_test(s, d):
    n = v.hits(s, d).select("peak", "key").distinct()
    c = n.groupBy("key").agg(F.count("*").alias("k"))
    both = motifs.cooccurrence(n).filter("key_a < key_b")
    x = both.join(c.select(C("key").alias("key_a"), C("k").alias("ka")), "key_a").join(c.select(C("key").alias("key_b"), C("k").alias("kb")), "key_b").join(F.broadcast(n.agg(F.countDistinct("peak").alias("n"))))
    return x.select("key_a", "key_b", F.round(motifs.fisher_greater("peaks", "ka", "kb", "n"), 6).alias("p"))


@query(f"""with h as ({HISTORY}), l as (select epoch, loss, coalesce(min(loss) over (order by epoch rows between 1 preceding and current row) >= lag(loss, 2) over (order by epoch), false) as plateau from h)
select epoch, loss, plateau, 0.004::double * power(0.5, least(sum(plateau::int) over (order by epoch rows unbounded preceding), 5)) as rate from l""", "points")
def plateau_rates(s, d):
    o = v.table(s, d, "orders").select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("epoch"), F.floor("o_totalprice").alias("x"))
    return stats.plateau_rates(o.groupBy("epoch").agg(F.floor(F.sum("x") / F.count("*")).alias("loss")), 2, 0.004)


@query("select a.id, a.key, b.key as key_b, (list((b.lo + b.hi) // 2 - (a.lo + a.hi) // 2 order by abs((b.lo + b.hi) // 2 - (a.lo + a.hi) // 2), (b.lo + b.hi) // 2 - (a.lo + a.hi) // 2))[1] as distance from hits a join hits b on a.peak = b.peak and a.key <> b.key and (b.hi <= a.lo or b.lo >= a.hi) group by a.id, a.key, b.key", "hits")
def motif_distances(s, d):
    return motifs.pair_distances(v.hits(s, d))


@query("""with n as (select peak, key, count(*) as n from hits group by all), k as (select key, count(*) as peaks, count(*) filter (n >= 2) as repeated from n group by key), t as (select count(distinct peak) as n from hits)
select key, peaks, repeated, round(greatest(0, 1 - list_sum(list_transform(generate_series(0, repeated), lambda i: exp(i * ln(peaks * (peaks - 1) / (2.0 * t.n)) - peaks * (peaks - 1) / (2.0 * t.n) - lgamma(i + 1))))), 6) as p from k, t""", "hits")
def self_cooccurrence(s, d):
    return motifs.self_cooccurrence(v.hits(s, d)).withColumn("p", F.round("p", 6))


@query(f"""with c as (select id % 20 as key, pos, base from ({LETTERS})),
n as (select key, pos, base, count(*) as n from c group by all), f as (select key, pos, n / sum(n) over (partition by key, pos) as p from n),
i as (select key, pos, round(sum((p + 0.001) / 1.004 * log2((p + 0.001) / 1.004 / 0.25)) + (4 - count(*)) * 0.001 / 1.004 * log2(0.001 / 1.004 / 0.25), 6) as ic from f group by all),
e as (select key, min(pos) filter (ic >= 0.2) as a, max(pos) filter (ic >= 0.2) as b from i group by key)
select key, pos, ic from i join e using (key) where a is null or pos between a - 1 and b + 1""", "sequences")
def trimmed_motifs(s, d):
    return motifs.trimmed(information(letters_of(v.sequences(s, d), (C("id") % 20).alias("key")), "key"), pad=1)


@query("""with l as (select id, w.chrom, lo, hi, lo + 55 as a, lo + 65 as b from windows w),
i as (select l.id, sum(case when t.lo >= a and t.lo < b then abs(value) else 0 end) as own, sum(abs(value)) as whole from l join track t on t.chrom = l.chrom and t.lo >= l.lo and t.lo < l.hi group by l.id)
select id, round(own / 10.0 / nullif(whole, 0), 6) as importance from l left join i using (id)""", "windows", "track")
def hit_importance(s, d):
    h = windows(s, d).select("id", "chrom", (C("start") + 55).alias("start"), (C("start") + 65).alias("end"), C("start").alias("lo"), C("end").alias("hi"))
    return iv.hit_importance(h, v.track(s, d), v.BIN).select("id", F.round("importance", 6).alias("importance"))


@query("""with t as (select id, n, sum(n) over (partition by id) as s, count(*) over (partition by id) as k from profiles), q as (select *, n / s as p, 1.0::double / k as u from t where s > 0)
select id, round(-(lgamma(max(s) + 1) - sum(lgamma(n + 1)) + sum(case when n > 0 then n * ln(p) else 0 end)) / max(k), 6) as mnll_best, round(-(lgamma(max(s) + 1) - sum(lgamma(n + 1)) + sum(n * ln(u))) / max(k), 6) as mnll_worst,
round(-sum(p * ln(p + 1e-7)), 6) as ce_best, round(-sum(p * ln(u + 1e-7)), 6) as ce_worst,
round(sqrt(greatest(sum((case when p > 0 then p * ln(p / ((p + u) / 2)) else 0 end) + u * ln(u / ((p + u) / 2))) / 2, 0)), 6) as jsd_worst from q group by id""", "profiles")
def metric_bounds(s, d):
    b = pf.metric_bounds(C("a"))
    named = {"mnll_best": b["mnll"][0], "mnll_worst": b["mnll"][1], "ce_best": b["cross_entropy"][0], "ce_worst": b["cross_entropy"][1], "jsd_worst": b["jsd"][1]}
    return v.arrays(s, d).filter(pf.total(C("a")) > 0).select("id", *(F.round(x, 6).alias(n) for n, x in named.items()))


@query("select key, count(*) as hits, count(distinct peak) as peaks, round(count(distinct peak) / (select count(distinct peak) from hits), 6) as share from hits group by key", "hits")
def hits_per_motif(s, d):
    h = v.hits(s, d)
    n = h.groupBy("key").agg(F.count("*").alias("hits"), F.countDistinct("peak").alias("peaks"))
    return n.join(F.broadcast(h.agg(F.countDistinct("peak").alias("all")))).select("key", "hits", "peaks", F.round(C("peaks") / C("all"), 6).alias("share"))


@query("""with m as (select id % 50 as coord, id // 50 as member, pos, (n + 1) / sum(n + 1) over (partition by id) as p, ln(sum(n) over (partition by id) + 1) as lt from profiles),
k as (select coord, avg(lt) as lt from m group by coord having count(distinct member) = (select count(distinct member) from m)),
g as (select coord, pos, exp(avg(ln(p))) as g from m group by all)
select coord, pos, round(g / sum(g) over (partition by coord) * exp(lt), 4) as value from g join k using (coord)""", "profiles")
def ensemble_profiles(s, d):
    w = W.partitionBy("id")
    m = v.profiles(s, d).select((C("id") % 50).alias("coord"), F.floor(C("id") / 50).alias("member"), "pos", ((C("n") + 1) / F.sum(C("n") + 1).over(w)).alias("p"), F.log(F.sum("n").over(w) + 1).alias("log_total"))
    members = m.agg(F.countDistinct("member")).first()[0]
    return motifs.ensemble_mean(m, members).select("coord", "pos", F.round("value", 4).alias("value"))


@query("select a.id // 2 as locus_id, a.pos, round((a.n + b.n) / 2.0, 6) as value from profiles a join profiles b on b.id = a.id + 1 and b.pos = 63 - a.pos where a.id % 2 = 0", "profiles")
def strand_averages(s, d):
    x = v.arrays(s, d).select(F.floor(C("id") / 2).alias("locus_id"), (C("id") % 2 == 1).alias("rev_comp"), C("a").alias("profile"), F.lit(0.0).alias("log_count"))
    return motifs.strand_average(x).select("locus_id", F.posexplode("profile").alias("pos", "value")).select("locus_id", C("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("select label, round(avg((ln(n + 1) - 3) * (ln(n + 1) - 3)), 6) as mse, round(avg(exp(3) - n * 3), 6) as poisson from profiles group by label", "profiles")
def count_losses(s, d):
    y = F.log1p("n") - 3
    return v.profiles(s, d).groupBy("label").agg(F.round(F.avg(y * y), 6).alias("mse"), F.round(F.avg(F.lit(math.exp(3)) - C("n") * 3), 6).alias("poisson"))


@query("select key, round(exp(-0.01 * greatest(avg(score) - min(score), 0)), 6) as tail, round(-ln(1 - 0.9) / nullif(quantile_cont(score, 0.9) - min(score), 0), 9) as rate from hits group by key", "hits")
def exponential_tails(s, d):
    n = v.hits(s, d).groupBy("key").agg(F.avg("score").alias("m"), F.min("score").alias("lo"), F.percentile("score", 0.9).alias("q"))
    return n.select("key", F.round(F.exp(-0.01 * F.greatest(C("m") - C("lo"), F.lit(0))), 6).alias("tail"), F.round(F.lit(-math.log(1 - 0.9)) / F.nullif(C("q") - C("lo"), F.lit(0)), 9).alias("rate"))


@query("select bin, sum(n) over (order by bin)::bigint as below from (select n // 50 as bin, count(*) as n from profiles group by 1)", "profiles")
def cumulative_histogram(s, d):
    n = v.profiles(s, d).groupBy(F.floor(C("n") / 50).alias("bin")).agg(F.count("*").alias("k"))
    return n.select("bin", F.sum("k").over(W.orderBy("bin")).alias("below"))


def smoothing_sql(sigma: float, width: int) -> str:
    """Rows id, pos, value: profiles smoothed, edges reflected."""
    w = pf.kernel(sigma, width).tolist()
    r = len(w) // 2
    taps = f"select unnest(generate_series({-r}, {r})) as d, unnest({w}) as w"
    return f"select o.id, o.pos, sum(t.w * p.n) as value from profiles o cross join ({taps}) t join (select id as k, max(pos) + 1 as size from profiles group by id) z on z.k = o.id join profiles p on p.id = o.id and p.pos = case when o.pos + t.d < 0 then -(o.pos + t.d) - 1 when o.pos + t.d >= size then 2 * size - 1 - (o.pos + t.d) else o.pos + t.d end group by o.id, o.pos"


@query(f"select id, pos, round(value, 6) as value from ({smoothing_sql(7.0, 21)})", "profiles")
def smoothed_profiles(s, d):
    x = v.arrays(s, d).select("id", F.posexplode(pf.smoothed(7.0, 21)(C("a"))).alias("pos", "value"))
    return x.select("id", C("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query()
def shuffled_sequences(s, d):
    return v.sequences(s, d).select("id", pf.dinucleotide_shuffled(C("seq"), C("id")).alias("shuffled"))


@query("""with m(key, strand, word, hit, miss) as (values ('cacgtg', '+', 'CACGTG', 1.0, -1.0), ('cacgtg', '-', 'CACGTG', 1.0, -1.0), ('gata', '+', 'GATA', 1.0, -2.0), ('gata', '-', 'TATC', 1.0, -2.0)),
p as (select id, seq, unnest(generate_series(0, length(seq) - 1)) as i from sequences where length(seq) > 0),
x as (select id, i, length(word) as n, key, strand, list_sum(list_transform(generate_series(1, length(word)), lambda j: case when seq[i + j] = word[j] then hit else miss end))::double as score from p, m where i + length(word) <= length(seq))
select id::varchar as chrom, i as lo, i + n as hi, key, strand, score from x where score >= 4""", "sequences")
def motif_scan(s, d):
    pwms = {"cacgtg": np.where(np.eye(4)[[1, 0, 1, 2, 3, 2]] > 0, 1.0, -1.0), "gata": np.where(np.eye(4)[[2, 0, 3, 0]] > 0, 1.0, -2.0)}
    chunks = v.sequences(s, d).select(C("id").cast("string").alias("chrom"), F.lit(0).cast("long").alias("start"), "seq")
    return lohi(motifs.scan_pwm(chunks, pwms, 4.0))


@query()
def clustered_profiles(s, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = v.arrays(s, d).select("id", array_to_vector("a").alias("features"))
    return KMeans(k=8, seed=1, maxIter=10).fit(x).transform(x).select("id", C("prediction").alias("cluster"))


@query()
def principal_components(s, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = v.arrays(s, d).select("id", array_to_vector("a").alias("features"))
    return PCA(k=5, inputCol="features", outputCol="pc").fit(x).transform(x).select("id", F.transform(vector_to_array("pc"), lambda y: F.round(y, 4)).alias("pc"))


@query()
def score_mixture(s, d):
    fit = motifs.score_mixture(v.profiles(s, d).select(C("n").cast("double").alias("n")), "n")
    return s.createDataFrame([(k, float(x)) for k, x in fit.items()], "parameter string, value double")


# the same results without a row a letter or place on the way


@query(SQL["dense_extraction"])
def dense_extraction_whole(s, d):
    """By slices of chunks."""
    x = tracks.dense(windows(s, d).select("id", "chrom", "start", "end"), v.track(s, d), keep=("start",))
    return x.select("id", "start", F.posexplode("values").alias("k", "value")).select("id", (C("start") + C("k")).alias("pos"), C("value").cast("long").alias("value"))


@query(SQL["one_hot_round_trip"])
def one_hot_round_trip_whole(s, d):
    """By the tensors that scorers get."""
    return scoring.through_tensors(v.sequences(s, d)).select("id", "back", "n_a")


@query(SQL["position_counts"])
def position_counts_whole(s, d):
    """By counts within batches."""
    return genome.position_counts(v.sequences(s, d), [])


def information_of(counts: DataFrame, *keys: str) -> DataFrame:
    p = genome.base_shares(counts, list(keys))
    return p.select(*keys, "pos", F.round(pf.information_content([C(b) for b in "ACGT"]), 6).alias("ic"))


@query(SQL["information_content"])
def information_content_whole(s, d):
    return information_of(genome.position_counts(v.sequences(s, d), []))


@query(SQL["trimmed_motifs"])
def trimmed_motifs_whole(s, d):
    x = v.sequences(s, d).select((C("id") % 20).alias("key"), "seq")
    return motifs.trimmed(information_of(genome.position_counts(x, ["key"]), "key"), pad=1)


from . import assembly, chains, motif_tables, predictions  # noqa: E402, F401 (they add their queries)
