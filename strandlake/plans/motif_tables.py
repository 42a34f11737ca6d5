"""Queries on motif matrices: weights, logo heights, contributions, similarity and score thresholds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import profile as pf
from ..operators import motifs
from ..sources import stores
from . import views as v
from .assembly import CHUNK, genome
from .registry import C, letters_of, query

#: Motifs of 20 groups of sequences: the shares of bases at the first 12 places of sequences that long.
PFM_SQL = "pfm as (select id % 20 as motif, p.pos, " + ", ".join(f"avg((seq[p.pos + 1] = '{b}')::int) as {b.lower()}" for b in "ACGT") + " from sequences, generate_series(0, 11) as p(pos) where length(seq) >= 12 group by all)"
PFM_IC = " + ".join(f"({b} + 0.001) / 1.004 * log2(({b} + 0.001) / 1.004 / 0.25)" for b in "acgt")
LOGO_IC = " + ".join(f"log2(({b} + 0.001) / 1.004) * {b}" for b in "acgt") + " + 2"


def pfm(s, d):
    letters = letters_of(v.sequences(s, d).filter(F.length("seq") >= 12), (C("id") % 20).alias("motif")).filter("pos < 12")
    return letters.groupBy("motif", "pos").agg(*(F.avg((C("base") == b).cast("double")).alias(b.lower()) for b in "ACGT"))


@query(f"with {PFM_SQL} select motif, pos, {', '.join(f'round({b} * ({PFM_IC}), 6) as {b}' for b in 'acgt')}, {', '.join(f'round({b} * ({LOGO_IC}), 6) as logo_{b}' for b in 'acgt')} from pfm", "sequences")
def motif_weights(s, d):
    p = [C(b) for b in "acgt"]
    ic = pf.information_content(p)
    return pfm(s, d).select("motif", "pos", *(F.round(x * ic, 6).alias(b) for b, x in zip("acgt", p, strict=True)), *(F.round(x, 6).alias(f"logo_{b}") for b, x in zip("acgt", pf.logo_heights(p), strict=True)))


@query(f"with {PFM_SQL}, c as (select motif, pos, a - 0.25 as a, c - 0.25 as c, g - 0.25 as g, t - 0.27 as t from pfm), k as (select motif from c group by motif having sum(a + c + g + t + 0.005 * (motif - 5)) >= 0) select motif, pos, round(a, 6) as a, round(c, 6) as c, round(g, 6) as g, round(t, 6) as t from c join k using (motif)", "sequences")
def contributing_motifs(s, d):
    x = pfm(s, d).select("motif", "pos", (C("a") - 0.25 + 0.005 * (C("motif") - 5)).alias("a"), *((C(b) - q).alias(b) for b, q in (("c", 0.25), ("g", 0.25), ("t", 0.27))))
    out = stores.motifs_of(x)
    return out.select("motif", "pos", F.round(C("a") - 0.005 * (C("motif") - 5), 6).alias("a"), *(F.round(b, 6).alias(b) for b in "cgt"))


@query(f"""with {PFM_SQL}, q as (select motif as query, pos as p, unnest(['a', 'c', 'g', 't']) as base, unnest([a, c, g, t]) as u from pfm),
t as (select motif as target, '+' as strand, pos as r, unnest(['a', 'c', 'g', 't']) as base, unnest([a, c, g, t]) as v from pfm union all select motif, '-', 11 - pos, unnest(['a', 'c', 'g', 't']), unnest([t, g, c, a]) from pfm),
m as (select query, target, strand, p - r as off, round(coalesce(corr(u, v), 0), 12) as c from q join t using (base) group by all having count(*) >= 20)
select query, target, round(max(c), 6) as correlation from m group by query, target""", "sequences")
def motif_similarity(s, d):
    x = pfm(s, d)
    return motifs.similarity(x, x).select("query", "target", F.round("correlation", 6).alias("correlation"))


@query("""with m(key, word) as (values ('cacgtg', 'CACGTG'), ('tgactca', 'TGACTCA')), p as (select id, seq, unnest(generate_series(0, length(seq) - 1)) as i from sequences where length(seq) > 0)
select id::varchar as chrom, i as lo, key from p, m where substr(seq, i + 1, length(word)) = word or substr(seq, i + 1, length(word)) = translate(reverse(word), 'ACGT', 'TGCA') group by all""", "sequences")
def motif_scan_by_p_value(s, d):
    """Thresholds at which random sequences score with probability under 2 / 4^length: only the words themselves pass. One pass for both, over chunks."""
    pwms = {k: np.where(np.eye(4)[["ACGT".index(c) for c in w]] > 0, 1.0, -1.0) for k, w in (("cacgtg", "CACGTG"), ("tgactca", "TGACTCA"))}
    found = motifs.scan(genome(s, d), pwms, CHUNK, thresholds={k: motifs.score_threshold(m, 2 / 4 ** len(m)) for k, m in pwms.items()})
    return found.select("chrom", C("start").alias("lo"), "key").distinct()


@query()
def shuffled_backgrounds(s, d):
    return motifs.with_backgrounds(v.sequences(s, d), pf.dinucleotide_shuffled, 2).select("id", "reference", "background")
