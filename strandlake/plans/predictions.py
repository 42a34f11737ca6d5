"""Queries on predicted profiles: the chain from logits to metrics, attributions and hit scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import profile as pf
from ..operators import motifs
from ..operators import predictions as pr
from . import views as v
from .registry import C, query, smoothing_sql

JOINT = "with x as (select id, pos, a / 100 as u, (b - 1) / 100 as w from pairs), m as (select id, greatest(max(u), max(w)) as top from x group by id), z as (select id, sum(exp(u - top)) + sum(exp(w - top)) as z from x join m using (id) group by id), c as (select id, ln(sum(a) + 1) as lc from pairs group by id)"


def joint(s, d):
    x = v.arrays(s, d).withColumn("lc", F.log1p(pf.total(C("a"))))
    return x.select("id", "label", "a", pf.joint_profiles(F.transform("a", lambda y: y / 100.0), F.transform("b", lambda y: (y - 1) / 100.0), C("lc")).alias("p"))


@query(f"{JOINT} select id, round(sum(exp(u - top) / z * exp(lc)), 5) as plus_total, round(sum(exp(w - top) / z * exp(lc)), 5) as minus_total, round(max(exp(u - top) / z * exp(lc)), 5) as most from x join m using (id) join z using (id) join c using (id) group by id", "pairs")
def joint_profiles(s, d):
    return joint(s, d).select("id", F.round(pf.total(C("p.plus")), 5).alias("plus_total"), F.round(pf.total(C("p.minus")), 5).alias("minus_total"), F.round(F.array_max("p.plus"), 5).alias("most"))


METRICS = f"""{JOINT}, p as (select id, pos, exp(u - top) / z * exp(lc) as p from x join m using (id) join z using (id) join c using (id)),
smooth as ({smoothing_sql(7.0, 81)}), t as (select id, pos, n as t, value as sm, p from profiles join smooth using (id, pos) join p using (id, pos)),
r as (select *, sum(t) over w as st, sum(p) over w as sp, sum(sm) over w as ss, rank() over (partition by id order by t) + (count(*) over (partition by id, t) - 1) / 2.0 as rt, rank() over (partition by id order by p) + (count(*) over (partition by id, p) - 1) / 2.0 as rp from t window w as (partition by id)),
q as (select id, case when max(st) > 0 and max(sp) > 0 then sqrt(greatest(sum((case when sm > 0 then sm / ss * ln(sm / ss / ((sm / ss + p / sp) / 2)) else 0 end) + (case when p > 0 then p / sp * ln(p / sp / ((sm / ss + p / sp) / 2)) else 0 end)) / 2, 0)) else 0 end as jsd,
case when max(st) > 0 and max(sp) > 0 then -sum(sm / nullif(ss, 0) * ln(p / sp + 1e-7)) else 0 end as cross_entropy, case when max(st) > 0 and max(sp) > 0 then avg((t - p) * (t - p)) else 0 end as mse, coalesce(corr(t, p), 0) as pearson, coalesce(corr(rt, rp), 0) as spearman from r group by id)"""


def examples(s, d):
    return joint(s, d).select("id", "label", C("a").alias("truth"), C("p.plus").alias("predicted"))


@query(f"{METRICS} select id, round(jsd, 5) as jsd, round(cross_entropy, 5) as cross_entropy, round(mse, 3) as mse, round(pearson, 5) as pearson from q", "profiles", "pairs")
def prediction_metrics(s, d):
    m = pr.metrics(examples(s, d))
    return m.select("id", F.round("jsd", 5).alias("jsd"), F.round("cross_entropy", 5).alias("cross_entropy"), F.round("mse", 3).alias("mse"), F.round("pearson", 5).alias("pearson"))


@query(f"""{METRICS} select metric, round(min(value), 4) as least, round(median(value), 4) as middle, round(max(value), 4) as most from (select 'jsd' as metric, jsd as value from q union all select 'cross_entropy', cross_entropy from q union all select 'pearson', pearson from q) group by metric""", "profiles", "pairs")
def metric_summary(s, d):
    rows = pr.metric_rows(pr.metrics(examples(s, d)).select("id", "jsd", "cross_entropy", "pearson"), ["id"])
    return pr.summary(rows).select("metric", *(F.round(c, 4).alias(c) for c in ("least", "middle", "most")))


@query("""with t as (select label, id, sum(a) as x, max(b) as y from pairs group by label, id), r as (select *, rank() over (partition by label order by x) + (count(*) over (partition by label, x) - 1) / 2.0 as rx, rank() over (partition by label order by y) + (count(*) over (partition by label, y) - 1) / 2.0 as ry from t)
select label, round(coalesce(corr(x, y), 0), 6) as pearson, round(coalesce(corr(rx, ry), 0), 6) as spearman from r group by label""", "pairs")
def track_correlations(s, d):
    x = v.arrays(s, d).select("label", pf.total(C("a")).alias("x"), F.array_max("b").alias("y"))
    return pr.correlations(x, "label", "x", "y").select("label", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("""with t as (select *, a / 100 as u, avg(a / 100) over (partition by id) as m from pairs), c as (select id, pos, u - m as x from t), z as (select id, sum(exp(x)) as z from c group by id)
select id, round(sum(exp(x) / z * x), 5) as weighted from c join z using (id) group by id""", "pairs")
def weighted_logits(s, d):
    return v.arrays(s, d).select("id", F.round(pf.weighted_sum_of_logits(F.transform("a", lambda x: x / 100.0)), 5).alias("weighted"))


@query("select id, pos, round(n / greatest(max(n) over (partition by id), 1), 6) as share from profiles", "profiles")
def max_normalised_profiles(s, d):
    x = v.arrays(s, d).select("id", F.posexplode(pf.max_normalised(C("a"))).alias("pos", "share"))
    return x.select("id", C("pos").cast("long").alias("pos"), F.round("share", 6).alias("share"))


@query("select id, pos - 22 as pos, n as value from profiles where pos between 22 and 41", "profiles")
def centre_cuts(s, d):
    x = v.arrays(s, d).select("id", F.posexplode(pf.centre_cut(C("a"), 20)).alias("pos", "value"))
    return x.select("id", C("pos").cast("long").alias("pos"), C("value").cast("long").alias("value"))


BASES = "select id as example, pos % 8 as reference, pos // 32 as pos, pos // 8 % 4 as base, n / 100.0::double as multiplier, n % 7 / 10.0::double as background from profiles where pos < 64"


def attribution_rows(s, d):
    """Two positions of four bases and eight references for each example."""
    p = v.profiles(s, d)
    return p.select(C("id").alias("example"), (C("pos") % 8).alias("reference"), F.floor(C("pos") / 32).alias("pos"), (F.floor(C("pos") / 8) % 4).alias("base"), (C("n") / 100.0).alias("multiplier"), (C("n") % 7 / 10.0).alias("background"))


@query(f"with b as ({BASES}), w as (select example, reference, pos, sum(background * multiplier) as was from b group by all) select example, pos, base, round(avg(multiplier - was), 7) as contribution from b join w using (example, reference, pos) group by all", "profiles")
def hypothetical_contributions(s, d):
    out = pr.hypothetical_contributions(attribution_rows(s, d), ["example"])
    return out.select("example", "pos", "base", F.round("contribution", 7).alias("contribution"))


@query("select id, pos, n as score from (select id, pos // 4 as pos, pos % 4 as base, n, (id + pos // 4) % 4 as present from profiles) where base = present", "profiles")
def projected_scores(s, d):
    at = F.sequence(F.lit(0), F.lit(15))
    hot = F.transform(at, lambda i: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.when((C("id") + i) % 4 == b, 1.0).otherwise(0.0)))
    scores = F.transform(at, lambda i: F.slice("a", i * 4 + 1, F.lit(4)))
    x = v.arrays(s, d).select("id", F.posexplode(pf.projected(hot, scores)).alias("pos", "score"))
    return x.select("id", C("pos").cast("long").alias("pos"), C("score").cast("long").alias("score"))


@query("select id // 100 as chrom, id % 100 as attribution_index, min(id) as id from profiles group by id // 100, id % 100", "profiles")
def predictions_of_attributions(s, d):
    """Repeated predictions: the first of each coordinate meets its attribution."""
    x = v.arrays(s, d).select(F.floor(C("id") / 100).alias("chrom"), (C("id") % 100).alias("start"), (C("id") % 100 + 1).alias("end"), "id")
    again = x.unionByName(x.withColumn("id", C("id") + 1_000_000))
    attributions = x.select("chrom", "start", "end", C("start").alias("attribution_index"))
    return pr.aligned(again, attributions, "id").select("chrom", "attribution_index", "id")


SCORE = "case when value % 97 = 0 then 'nan'::double else value / 100.0::double end"


@query(f"select key, count(*) as hits, count(*) filter (not isnan(x)) as finite, round(sum(case when isnan(x) then 0 else x end), 4) as total from (select key, {SCORE.replace('value', 'score')} as x from hits) group by key", "hits")
def finite_scores(s, d):
    x = v.hits(s, d).select("key", F.when(C("score") % 97 == 0, F.lit(float("nan"))).otherwise(C("score") / 100.0).alias("x"))
    return x.groupBy("key").agg(F.count("*").alias("hits"), F.sum(pf.finite(C("x")).cast("long")).alias("finite"), F.round(F.sum(pf.without_nan(C("x"))), 4).alias("total"))


@query("select id, round(0.01 * exp(-0.01 * score), 9) as pdf, round(1 - exp(-0.01 * score), 9) as cdf, round(exp(-0.01 * least(greatest(score - 500, (select min(score) from hits)), (select max(score) from hits))), 9) as p from hits", "hits")
def exponential_scores(s, d):
    h = v.hits(s, d)
    x = h.join(F.broadcast(h.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))))
    rate, score = F.lit(0.01), C("score").cast("double")
    p = pf.hit_p_value(score, F.lit(500.0), rate, C("lo").cast("double"), C("hi").cast("double"))
    return x.select("id", F.round(pf.exponential_pdf(score, rate), 9).alias("pdf"), F.round(pf.exponential_cdf(score, rate), 9).alias("cdf"), F.round(p, 9).alias("p"))


@query("select round(max(-ln(1 - p) / (q - 500)), 9) as rate from (select unnest(l) as p, unnest(q) as q from (select l, quantile_cont(score, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) as q from hits, (select [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95] as l) where score >= 500 group by l)) where q > 500", "hits")
def tightest_rate(s, d):
    rate = motifs.tight_rate(v.hits(s, d).select(C("score").cast("double").alias("x")), "x", 500.0)
    return s.range(1).select(F.round(F.lit(rate), 9).alias("rate"))


@query()
def discovered_hits(s, d):
    """Scores by the square of the hits' values, of which the greatest stand out of an exponential."""
    return motifs.hits_by_discovery(v.hits(s, d).select("id", "key", F.pow(C("score") / 1000.0, 2).alias("score")), "score").select("id", "key", "score", "p")


@query("select id, round((l - 1) * (l - 1), 6) as mse, round(exp(1.0::double) - l, 6) as poisson from (select id, ln(sum(n) + 1) as l from profiles group by id)", "profiles")
def losses_by_name(s, d):
    x = v.arrays(s, d).select("id", F.log1p(pf.total(C("a"))).alias("l"))
    return x.select("id", *(F.round(pf.count_loss(n, C("l"), F.lit(1.0)), 6).alias(n.lower()) for n in ("MSE", "POISSON")))


@query("select id, pos + 41 as in_input, pos - 15 as in_profile from points", "points")
def seqlet_places(s, d):
    x = v.points(s, d)
    return x.select("id", pf.seqlet_shift(C("pos"), 182, 100).alias("in_input"), pf.seqlet_shift(C("pos"), 182, 100, 70).alias("in_profile"))
