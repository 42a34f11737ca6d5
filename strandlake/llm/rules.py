"""Quality rules with risk-controlled thresholds, in DataFrame and SQL expressions only.

Base measures of a text are exact counts. Each rule compares a ratio of them with a cutoff,
and a document above any cutoff is rejected. Cutoffs are chosen for each stratum (language)
on labelled documents of quality 1 that the base rules keep. The settings are walked in a
fixed order: all rules off, then rule by rule on its loosest cutoff, then rule by rule on
the next one, and so on, each setting rejecting what the one before does. A setting is
admissible when the exact binomial test rejects "good documents are rejected, by all rules
together, with probability over ALPHA": P(Bin(n, ALPHA) <= k) <= DELTA / strata, for k
rejected of n good documents. The walk ends at the first setting that is not admissible, and
the one before it is used. A fixed sequence of tests needs no correction of its own, and
dividing DELTA by the strata is Bonferroni's, so with probability 1 - DELTA no stratum loses
more than ALPHA of its good documents. With 4 strata, 144 good documents let rules act.

Null and empty texts: no words, so base_failed. Texts are measured whole, very long ones
too, in memory of a few times their words. Documents of null or empty lang form one stratum.
Labels of unknown documents or null quality count nowhere; with too few labels, or none, or
an empty table, only the base rules act. A doc_id labelled or listed more than once counts
once for each pair; a null doc_id has no label. Repeated rows get a verdict each. Other
columns are not read; columns that digest() returns replace others of their names, and
stage() adds none.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, columns, free, stored

ALPHA, DELTA = 0.03, 0.05
#: Each rule's measure, and its cutoffs from the loosest on.
RULES = {
    "symbols": ("n_symbols / n_words", (2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05)),
    "dup_lines": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
    "repeats": ("n_repeat_words / n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02)),
    "long_words": ("word_chars / n_words", (30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.0)),
    "short_words": ("n_words / word_chars", (0.7, 0.5, 0.4, 0.36, 0.33, 0.3, 0.28, 0.25, 0.22, 0.2)),
}
LEVELS = 10
STEPS = LEVELS * len(RULES)

_SPACE = r" \t\n\u000b\u000c\r"


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


_WORDS = f"if(trim(BOTH '{_SPACE}' FROM t) = '', array(), split(trim(BOTH '{_SPACE}' FROM t), '[ \\\\t-\\\\r]+'))"
# Starts of 3-word windows whose words occur again. Each window's hash gives up its low b bits
# to its place, 2^b > number of words, so that sorting plain longs brings equal windows together.
# Where windows of one hash have different words, the windows themselves are sorted instead.
_HIGH = "shiftright({}, length(bin(n)))"
_PLACE = "({} & (shiftleft(1L, length(bin(n))) - 1))"


def _same(a: str, b: str) -> str:
    return " and ".join(f"get(w, cast({a} as int) + {i}) = get(w, cast({b} as int) + {i})" for i in range(3))


_MIXED = f"n > 3 and exists(sequence(1, n - 3), k -> {_HIGH.format('s[k]')} = {_HIGH.format('s[k - 1]')} and not ({_same(_PLACE.format('s[k]'), _PLACE.format('s[k - 1]'))}))"
_HASHED = (
    f"transform(filter(sequence(0, n - 3), k -> coalesce({_HIGH.format('s[k]')} = {_HIGH.format('get(s, k - 1)')}, false)"
    f" or coalesce({_HIGH.format('s[k]')} = {_HIGH.format('get(s, k + 1)')}, false)), k -> {_PLACE.format('s[k]')})"
)
_EXACT = _let(
    "g",
    "sort_array(transform(sequence(0, n - 3), i -> struct(struct(w[i] as a, w[i + 1] as b, w[i + 2] as c) as x, cast(i as long) as i)))",
    "transform(filter(sequence(0, n - 3), k -> coalesce(g[k].x = get(g, k - 1).x, false) or coalesce(g[k].x = get(g, k + 1).x, false)), k -> g[k].i)",
)
_STARTS = _let(
    "s",
    f"sort_array(transform(sequence(0, n - 3), i -> shiftleft({_HIGH.format('xxhash64(w[i], w[i + 1], w[i + 2])')}, length(bin(n))) + i))",
    f"sort_array(if({_MIXED}, {_EXACT}, {_HASHED}))",
)
_REPEATS = f"if(n < 3, 0L, {_let('p', _STARTS, 'aggregate(sequence(0, size(p)), 0L, (a, j) -> a + if(get(p, j) is null, 0L, least(3L, coalesce(get(p, j + 1) - get(p, j), 3L))))')})"
_LINES = r"filter(split(t, '\n'), l -> l rlike '[^ \\t-\\r]')"
MEASURES = _let(
    "t",
    "coalesce(text, '')",
    _let(
        "w",
        _WORDS,
        _let(
            "n",
            "size(w)",
            _let(
                "l",
                _LINES,
                f"""named_struct('n_words', cast(n as long), 'word_chars', cast(length(concat_ws('', w)) as long),
                'n_symbols', cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '')) as long),
                'n_lines', cast(size(l) as long), 'n_dup_lines', cast(size(l) - size(array_distinct(l)) as long),
                'n_repeat_words', {_REPEATS})""",
            ),
        ),
    ),
)
NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def base_failed(at: str = "") -> str:
    """at: what stands before the measures' names."""
    return f"({at}n_words < 50 or 100 * {at}n_repeat_words > 50 * {at}n_words)"


def first_step(at: str = "") -> str:
    """The first step of the walk that rejects a document, from 0; STEPS where none does."""
    out = []
    for j, (measure, cuts) in enumerate(RULES.values()):
        over, under = measure.split(" / ")
        out.append(_let("x", f"coalesce(cast(try_divide({at}{over}, {at}{under}) as double), -1D)", _let("l", f"size(filter(array({', '.join(f'{c}D' for c in cuts)}), c -> c >= x))", f"if(l < {LEVELS}, l * {len(RULES)} + {j}, {STEPS})")))
    return f"least({', '.join(out)})"


def measures(docs: DataFrame) -> DataFrame:
    """docs with the base measures and base_failed, in one pass without a shuffle; clashing columns are replaced."""
    out = docs.drop(*NAMES, "base_failed")
    m = free(out, "_m")
    out = out.withColumn(m, F.expr(MEASURES))
    return out.select(*columns(out.drop(m)), *(F.col(f"{m}.{n}").alias(n) for n in NAMES)).withColumn("base_failed", F.expr(base_failed()))


def _log_factorial(x: str) -> str:
    """Exact below 10, Stirling's series above (error under 1e-12)."""
    return f"if({x} < 10, ln(factorial(cast({x} as int) % 20)), {x} * ln({x}) - {x} + 0.5 * ln(6.283185307179586 * {x}) + 1 / (12.0 * {x}) - 1 / (360.0 * power({x}, 3)) + 1 / (1260.0 * power({x}, 5)))"


def _lower_tail(alpha: float) -> str:
    """P(Bin(n, alpha) <= k) for k < n * alpha, from k downwards; terms beyond 12 standard deviations are below a double's precision."""
    odds = (1 - alpha) / alpha
    first = f"exp(greatest(-740D, {_log_factorial('n')} - {_log_factorial('k')} - {_log_factorial('(n - k)')} + k * {math.log(alpha)!r}D + (n - k) * {math.log1p(-alpha)!r}D))"
    rest = (
        f"aggregate(sequence(0L, cast(least(k, floor(12 * sqrt(n * {alpha}D) + 40)) as long)), named_struct('term', 1D, 'sum', 0D),"
        f" (a, j) -> named_struct('term', a.term * (k - j) / (n - k + j + 1) * {odds!r}D, 'sum', a.sum + a.term), a -> a.sum)"
    )
    return f"{first} * {rest}"


def admitted(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, n (its good documents), steps: how many steps of the walk are admissible. Where there are none, no row."""
    good = measured.filter(~F.expr(base_failed())).join(labels.filter("quality = 1").select("doc_id"), "doc_id").select(F.coalesce("lang", F.lit("")).alias("stratum"), F.expr(first_step()).alias("first"))
    counts = checkpointed(good.groupBy("stratum", "first").agg(F.count("*").alias("m")))
    strata = counts.agg(F.countDistinct("stratum")).first()[0] or 1
    # the sums over a stratum's counts, of which there are STEPS + 1 at most
    each = counts.groupBy("stratum").agg(F.sum("m").cast("double").alias("n"), F.map_from_entries(F.collect_list(F.struct("first", "m"))).alias("by"))
    step = F.explode(F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda t: F.struct(t.alias("t"), F.aggregate(F.sequence(F.lit(0), t), F.lit(0.0), lambda a, i: a + F.coalesce(F.try_element_at("by", i), F.lit(0))).alias("k"))))
    tested = each.select("stratum", "n", step.alias("x")).select("stratum", "n", "x.t", "x.k").filter(F.col("k") < F.col("n") * ALPHA)
    # k grows along the walk, so the admissible settings are its beginning
    return tested.filter(F.expr(_lower_tail(ALPHA)) <= DELTA / strata).groupBy("stratum").agg(F.first("n").cast("long").alias("n"), F.count("*").cast("int").alias("steps"))


def cutoffs(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, n, rule, cutoff: what the admissible steps amount to; null where a rule is off."""
    rules = F.expr("array(" + ", ".join(f"struct('{r}' as rule, {j} as j, array({', '.join(f'{c}D' for c in cuts)}) as cuts)" for j, (r, (_, cuts)) in enumerate(RULES.items())) + ")")
    each = admitted(measured, labels).select("stratum", "n", "steps", F.explode(rules).alias("r"))
    return each.select("stratum", "n", "r.rule", F.expr(f"get(r.cuts, cast(floor((steps - r.j - 1) / {len(RULES)}D) as int))").alias("cutoff"))


#: Up to so many strata the steps (a row of two numbers each) are broadcast; above, joined by shuffling.
BROADCAST_STRATA = 10_000


def _with_steps(docs: DataFrame, chosen: DataFrame) -> tuple[DataFrame, str]:
    """docs with the admitted steps of their stratum, and that column's name."""
    steps, stratum = free(docs, "_steps"), free(docs, "_stratum")
    chosen = checkpointed(chosen.select(F.col("stratum").alias(stratum), F.col("steps").alias(steps)))
    if chosen.count() <= BROADCAST_STRATA:
        chosen = F.broadcast(chosen)
    return docs.join(chosen, F.coalesce(F.col("lang"), F.lit("")) == F.col(stratum), "left"), steps


def kept(steps: str, at: str = "") -> str:
    return f"not {base_failed(at)} and {first_step(at)} >= coalesce({steps}, 0)"


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op8: measures and verdicts. The texts are read once; only numbers are kept and shuffled."""
    measured = checkpointed(measures(docs.select("doc_id", "lang", "text")).drop("text"))
    out, steps = _with_steps(measured, admitted(measured, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.expr(kept(steps)).alias("kept"))


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: documents that the rules reject go. Texts are measured once and stored with their measures."""
    m = free(docs, "_m")
    measured = stored(docs.withColumn(m, F.expr(MEASURES)))
    out, steps = _with_steps(measured, admitted(measured.select("doc_id", "lang", f"{m}.*"), labels))
    return out.filter(F.expr(kept(steps, f"{m}."))).select(*columns(docs))


_SQL_FIRST = ", ".join(f"coalesce(list_position(list_transform({list(cuts)}, lambda c: {m.split(' / ')[0]}::double / nullif({m.split(' / ')[1]}, 0) > c), true) * {len(RULES)} - {len(RULES) - j}, {STEPS})" for j, (m, cuts) in enumerate(RULES.values()))
#: The same in DuckDB.
SQL = rf"""
with d as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t, row_number() over () as rid from documents),
x as (select *, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda y: y <> '') as w,
      list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^ \t\n\x0B\f\r]')) as l from d),
g as (select rid, unnest(generate_series(1, len(w) - 2)) as i, w from x where len(w) > 2),
g3 as (select rid, i, [w[i], w[i + 1], w[i + 2]] as gram from g),
r as (select rid, count(distinct p) as n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by rid, gram) as c from g3) where c > 1) group by rid),
m as (select doc_id, stratum, len(w)::bigint as n_words, length(list_aggregate(['', ''] || w, 'string_agg', ''))::bigint as word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
      coalesce(n_repeat_words, 0)::bigint as n_repeat_words from x left join r using (rid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, least({_SQL_FIRST}) as first_step from m),
good as (select b.* from b join labels using (doc_id) where quality = 1 and not base_failed),
sizes as (select stratum, count(*)::double as n from good group by stratum),
steps as (select s.stratum, n, t, (select count(*) from good g where g.stratum = s.stratum and g.first_step <= t)::double as k from sizes s, generate_series(0, {STEPS - 1}) as u(t)),
p as (select stratum, list_sum(list_transform(generate_series(0, k::bigint), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) as tail
      from steps where k < n * {ALPHA}),
c as (select stratum, count(*) as steps from p where tail <= {DELTA} / (select count(*) from sizes) group by stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and first_step >= coalesce(steps, 0) as kept
from b left join c using (stratum)
"""
