"""Queries on examples assembled from genome and tracks, on row selection, orders and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import profile as pf
from ..operators import assembly as asm
from ..operators import genome as gn
from ..operators import intervals as iv
from ..operators import sampling, tracks
from ..sources import stores
from . import views as v
from .registry import DRAW, C, lohi, query, windows

CHUNK = 100


def contig_chunks(s, d, size):
    """chrom, chunk_id, seq: sequences as contigs in chunks, cut in one pass over each; an empty or null one is a chunk."""
    cut = F.when(F.length("seq") > 0, F.regexp_extract_all("seq", F.lit(f".{{1,{size}}}"), F.lit(0))).otherwise(F.array("seq"))
    return v.sequences(s, d).select(C("id").alias("chrom"), F.posexplode(cut).alias("chunk_id", "seq")).withColumn("chunk_id", C("chunk_id").cast("long"))


def genome(s, d):
    """Sequences as contigs in chunks."""
    return contig_chunks(s, d, CHUNK).select("chrom", "chunk_id", (C("chunk_id") * CHUNK).alias("start"), "seq")


@query("""with z as (select id, seq, length(seq) as size from sequences where length(seq) > 0), b as (select id, seq, unnest(generate_series(0, size - 1, 20)) as lo from z),
n as (select id, lo, length(x) - length(replace(replace(x, 'G', ''), 'C', '')) as n from (select id, lo, substr(seq, lo + 1, 50) as x from b))
select id as chrom, lo, lo + 50 as hi, n, (200 * n + 50) // 100 as gc from n""", "sequences")
def genome_gc_bins(s, d):
    """Windows of 50 each 20 places over chunks of 100, as percent of 50 at the contigs' ends too."""
    sizes = v.sequences(s, d).select(C("id").alias("chrom"), F.length("seq").cast("long").alias("size"))
    return lohi(gn.gc_bins(genome(s, d), sizes, 50, 20))


@query("select id, length(x) - length(replace(replace(x, 'G', ''), 'C', '')) as n, (200 * (length(x) - length(replace(replace(x, 'G', ''), 'C', ''))) + 150) // 300 as gc from (select id, substr(seq, (id * 37 % 260 + 1)::bigint, 150) as x from sequences)", "sequences")
def gc_of_loci(s, d):
    return gn.base_counts(genome_loci(s, d), genome(s, d), CHUNK).select("id", "n", gn.nominal_percent(C("n"), 150).alias("gc"))


def genome_loci(s, d):
    at = C("id") * 37 % 260
    return v.sequences(s, d).select("id", C("id").alias("chrom"), at.alias("start"), (at + 150).alias("end"))


@query("select id, rpad(substr(seq, (id * 37 % 260 + 1)::bigint, 150), 150, 'N') as seq from sequences", "sequences")
def fetched_sequences(s, d):
    return asm.fetched(genome_loci(s, d), genome(s, d), CHUNK).select("id", "seq")


@query("select w.id, string_agg(coalesce(t.value, 0)::bigint::varchar, ',' order by k) as values from (select id, chrom, lo, unnest(generate_series(0, 119)) as k from windows) w left join track t on t.chrom = w.chrom and t.lo = w.lo + w.k group by w.id", "windows", "track")
def dense_windows(s, d):
    return asm.dense(windows(s, d).select("id", "chrom", "start", "end"), v.track(s, d)).select("id", F.array_join(F.transform("values", lambda x: x.cast("long").cast("string")), ",").alias("values"))


RUN_CELLS = "select w.id, k, coalesce(r.value, 0) as value from (select id, chrom, lo, unnest(generate_series(0, 119)) as k from windows) w left join runs r on r.chrom = w.chrom and r.lo <= w.lo + w.k and w.lo + w.k < r.hi"


@query(f"select id, string_agg(value::bigint::varchar, ',' order by k) as values from ({RUN_CELLS}) group by id", "windows", "runs")
def dense_from_runs(s, d):
    """Windows over runs of any length, across the borders of small chunks."""
    x = tracks.dense(windows(s, d).select("id", "chrom", "start", "end"), v.runs(s, d), 100)
    return x.select("id", F.array_join(F.transform("values", lambda y: y.cast("long").cast("string")), ",").alias("values"))


@query(f"""with c as ({RUN_CELLS}), p as (select w.id, k, coalesce(t.value, 0) as value from (select id, chrom, lo, unnest(generate_series(0, 119)) as k from windows) w left join track t on t.chrom = w.chrom and t.lo = w.lo + w.k),
f as (select id, string_agg(c.value::bigint::varchar, ',' order by k) as r, string_agg(p.value::bigint::varchar, ',' order by k) as t, string_agg(c.value::bigint::varchar, ',' order by k desc) as rb, string_agg(p.value::bigint::varchar, ',' order by k desc) as tb from c join p using (id, k) group by id)
select id, case when id % 2 = 1 then tb else r end as plus, case when id % 2 = 1 then rb else t end as minus from f""", "windows", "runs")
def stacked_profiles(s, d):
    """Two strands of a task; loci of odd ids are reversed."""
    loci = windows(s, d).select("id", "chrom", "start", "end", (C("id") % 2 == 1).alias("rev_comp"))
    x = tracks.stacked(loci, [v.runs(s, d), v.track(s, d)], reverse="rev_comp")
    text = [F.array_join(F.transform(C("profiles")[i], lambda y: y.cast("long").cast("string")), ",").alias(n) for i, n in enumerate(("plus", "minus"))]
    return x.select("id", *text)


@query("""with o as (select *, lag(hi) over w as ph, lag(value) over w as pv from runs where value <> 0 window w as (partition by chrom order by lo)),
i as (select *, sum(case when ph = lo and pv = value then 0 else 1 end) over (partition by chrom order by lo rows unbounded preceding) as g from o)
select chrom, min(lo) as lo, max(hi) as hi, min(value)::double as value from i group by chrom, g""", "runs")
def runs_of_chunks(s, d):
    """A track through chunks and back: neighbours of equal value become one run."""
    return lohi(tracks.runs(tracks.chunked(v.runs(s, d), 64), 64))


@query("""with e as (select id, string_agg(a::bigint::varchar, ',' order by pos) as plus, string_agg(b::bigint::varchar, ',' order by pos) as minus, string_agg(a::bigint::varchar, ',' order by pos desc) as plus_back, string_agg(b::bigint::varchar, ',' order by pos desc) as minus_back, sum(a) as n, sum(b) as m from pairs group by id),
g as (select id, rpad(substr(seq, (id * 37 % 260 + 1)::bigint, 150), 150, 'N') as seq from sequences)
select id, 0 as rev_comp, seq, plus, minus, round(ln(n + 1), 6) as plus_count, round(ln(m + 1), 6) as minus_count from e join g using (id)
union all select id, 1, translate(reverse(seq), 'ACGT', 'TGCA'), minus_back, plus_back, round(ln(m + 1), 6), round(ln(n + 1), 6) from e join g using (id)""", "pairs", "sequences")
def training_examples(s, d):
    x = asm.fetched(genome_loci(s, d), genome(s, d), CHUNK).select("id", "seq").join(v.arrays(s, d).select("id", C("a").alias("plus"), C("b").alias("minus")), "id")
    text = {k: F.array_join(F.transform(k, lambda y: y.cast("long").cast("string")), ",").alias(k) for k in ("plus", "minus")}
    return asm.both_strands(x).select("id", "rev_comp", "seq", *text.values(), *(F.round(F.log1p(pf.total(C(k))), 6).alias(f"{k}_count") for k in text))


@query("select label, (case when len(embedding) = 0 then 0 else 2 + (label % 2 = 0)::int + (label % 3 = 0)::int end)::int as tracks from (select distinct on (label) label, embedding from embeddings order by label, vec_id)", "points")
def bias_track_counts(s, d):
    tasks = v.table(s, d, "embeddings").select("label").distinct()
    smoothing = F.array(F.when(C("label") % 2 == 0, F.lit(7.0)), F.when(C("label") % 3 == 0, F.lit(9.0)))
    return tasks.select("label", asm.bias_tracks(F.array(F.lit("plus"), F.lit("minus")), smoothing).cast("int").alias("tracks"))


def two_tracks(s, d):
    """Totals (id, track, total) of windows over the values and over the number of events."""
    loci = windows(s, d).select("id", "chrom", "start", "end")
    events = v.points(s, d).groupBy("chrom", C("pos").alias("start")).agg(F.count("*").alias("value")).withColumn("end", C("start") + 1)
    sums = [iv.coverage_sums(loci, t, v.BIN, ["id", "chrom", "start", "end"]).select("id", F.lit(n).alias("track"), "total") for n, t in (("value", v.track(s, d)), ("events", events))]
    return sums[0].unionByName(sums[1])


TWO = "select w.id, t.track, coalesce(sum(x), 0)::bigint as total from windows w cross join (values ('value'), ('events')) as t(track) left join (select chrom, pos, 'value' as track, sum(value) as x from points group by all union all select chrom, pos, 'events', count(*) from points group by all) p on p.chrom = w.chrom and p.track = t.track and pos >= lo and pos < hi group by w.id, t.track"


@query(f"select id, avg(total) as mean from ({TWO}) group by id", "windows", "points")
def mean_across_tracks(s, d):
    return asm.mean_over_tracks(two_tracks(s, d))


@query(f"select round(2.5 * avg(total), 6) as weight, count(*) as n from ({TWO})", "windows", "points")
def loss_weight_of_tracks(s, d):
    return asm.loss_weight(two_tracks(s, d), 5.0, original=True).withColumn("weight", F.round("weight", 6))


@query(f"select id, chrom, pos from points where value <= 5000 order by {DRAW.format(1)}, id limit (select floor(count(*) * 0.25)::bigint from points where value > 5000)", "points")
def background_sample(s, d):
    p = v.points(s, d).select("id", "chrom", "pos", "value")
    return sampling.sample_ratio(p.filter("value <= 5000"), "id", p.filter("value > 5000"), 0.25).drop("value")


@query(f"select id from points order by {DRAW.format(1)}, id limit (select count(*) - count(*) % 192 from points)", "points")
def rows_for_batches(s, d):
    return sampling.whole_batches(v.points(s, d).select("id"), "id", 64, 3)


@query("select id, chrom, k as row_idx from (select id, chrom, row_number() over (order by id) - 1 as k from points) where k in (select distinct o_custkey from orders)", "points")
def rows_by_index(s, d):
    index = v.table(s, d, "orders").select(C("o_custkey").alias("row_idx"))
    return sampling.by_index(v.points(s, d).select("id", "chrom"), "id", index)


@query("select id, chrom, lo, hi, chrom || '_' || lo || '_' || hi as coordinates, place from windows join (select c.column0 as chrom, c.column1 as place from (values ('view', 0), ('click', 1), ('purchase', 2)) c(column0, column1)) using (chrom)", "windows")
def ordered_loci(s, d):
    order = s.createDataFrame([("view", 0), ("click", 1), ("purchase", 2)], "chrom string, place int")
    by_text = asm.ordered(windows(s, d).drop("signal"), "text")
    return lohi(asm.ordered(by_text, "order", order))


@query("select region, count(l.id) as hits, coalesce(string_agg(l.id::varchar, ',' order by l.id), '') as ids from regions b left join loci l on l.chrom = b.chrom and st >= b_start and e <= b_end group by b.chrom, region", "regions", "loci")
def hits_of_each_region(s, d):
    hits = v.loci(s, d).select("id", "chrom", C("st").alias("start"), C("e").alias("end"))
    out = iv.lists_of_contained(hits, v.regions(s, d), v.BIN)
    return out.select("region", F.size("found").cast("long").alias("hits"), F.array_join(F.transform("found", lambda x: x.cast("string")), ",").alias("ids"))


@query("select h.id, h.key, p.k as peak_index, p.chrom from hits h join (select id, chrom, row_number() over (order by id) - 1 as k from points) p on p.k = h.id // 3", "hits", "points")
def hits_with_peaks(s, d):
    peaks = sampling.numbered(v.points(s, d).select("id", "chrom"), "id", "peak_index").select("peak_index", "chrom")
    return v.hits(s, d).select("id", "key", F.floor(C("id") / 3).alias("peak_index")).join(peaks, "peak_index")


def _positions(s, d, n=500, width=50):
    return asm.random_positions(v.sizes(s, d), n, width)


@query("""with r as (select range as id from range(500)), z as (select *, size - 49 as room, sum(size - 49) over (order by chrom) as upto from sizes),
a as (select id, (('0x' || left(md5(id::varchar || '/1'), 8))::bigint * 1048576 + ('0x' || left(md5(id::varchar || '/2'), 8))::bigint % 1048576) % (select sum(room) from z)::bigint as place from r)
select id, chrom, (place - (upto - room))::bigint as lo, (place - (upto - room) + 50)::bigint as hi from a join z on place >= upto - room and place < upto""", "sizes")
def random_positions(s, d):
    return lohi(_positions(s, d))


@query("select id, row_number() over (order by chrom, hi, lo, id) - 1 as place from windows", "windows")
def loci_by_end(s, d):
    return asm.numbered(windows(s, d), "end").select("id", "place")


@query("select id, row_number() over (order by signal desc, chrom, lo, id) - 1 as place from windows", "windows")
def loci_by_signal(s, d):
    return asm.numbered(windows(s, d), "signal").select("id", "place")


@query("select chrom, lo, lo + 50 as hi from (select chrom, unnest(generate_series(0, size - 50, 30)) as lo from sizes where size >= 50)", "sizes")
def sequential_positions(s, d):
    return lohi(asm.sequential_positions(v.sizes(s, d), 50, 30))


@query("""with t as (select id, pos, case when id % 2 = 0 then floor(n * 100.0::double / sum(n) over w) else ceil(n * 100.0::double / sum(n) over w) end / 100 as p from profiles window w as (partition by id)),
r as (select *, sum(p) over (partition by id) - 1 as d, row_number() over (partition by id order by p desc, pos) as most, row_number() over (partition by id order by p, pos) as least from t)
select id, pos, round(case when d > 0 and most = 1 or d <= 0 and least = 1 then p - d else p end, 6) as p from r""", "profiles")
def fixed_sums(s, d):
    """Shares in whole hundredths, which add up to less than 1, or more, until they are fixed."""
    x = v.arrays(s, d).withColumn("s", pf.total(C("a")))
    shares = F.transform("a", lambda y: F.when(C("id") % 2 == 0, F.floor(y * 100.0 / C("s"))).otherwise(F.ceil(y * 100.0 / C("s"))) / 100)
    return x.select("id", F.posexplode(pf.sum_fixed(shares)).alias("pos", "p")).select("id", C("pos").cast("long").alias("pos"), F.round("p", 6).alias("p"))


@query("select event_id as id, strftime(ts, '%Y-%m-%d_%H_%M_%S') as utc, strftime(ts - interval 5 hours, '%Y-%m-%d_%H_%M_%S') as west from events")
def time_tags(s, d):
    e = v.table(s, d, "events").select(C("event_id").alias("id"), C("ts").cast("timestamp").alias("ts"))
    return e.select("id", stores.time_tag(C("ts"), "UTC").alias("utc"), stores.time_tag(C("ts"), "Etc/GMT+5").alias("west"))
