"""The driver's tables as loci, tracks, sequences and profiles, in Spark and in DuckDB SQL.

Every view takes all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import beside

MINUTES = 43_200
BIN = 256


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def points(s: SparkSession, d: str) -> DataFrame:
    """id, chrom, pos, user_id, value (integer hundredths): an event each."""
    minute = F.expr("timestampdiff(MINUTE, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("chrom"), minute.alias("pos"), "user_id", F.floor(F.col("value") * 100).alias("value"))


def track(s: SparkSession, d: str) -> DataFrame:
    return points(s, d).groupBy("chrom", "pos").agg(F.sum("value").alias("value")).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value")


def runs(s: SparkSession, d: str) -> DataFrame:
    """A track of runs: the value of each minute with events holds until the next one, for 40 minutes at most."""
    t = track(s, d).select("chrom", "start", "value", F.col("start").alias("id"))
    out = beside(t, ["chrom"], F.col("start"), "_next", 1 << 12, after=True)
    return out.select("chrom", "start", F.least(F.coalesce("_next", F.col("start") + 40), F.col("start") + 40).alias("end"), "value")


def loci(s: SparkSession, d: str) -> DataFrame:
    """Peaks of 10 with their summits in the middle."""
    return points(s, d).select("id", "chrom", (F.col("pos") - 5).alias("st"), (F.col("pos") + 5).alias("e"), F.lit(5).alias("summit"), F.col("value").alias("signal"), "user_id")


def regions(s: SparkSession, d: str) -> DataFrame:
    """Blacklisted half hours: the first event of each user and type."""
    return points(s, d).groupBy("chrom", "user_id").agg(F.min("pos").alias("b_start")).select("chrom", "b_start", (F.col("b_start") + 30).alias("b_end"), F.col("user_id").alias("region"))


def sizes(s: SparkSession, d: str) -> DataFrame:
    return points(s, d).select("chrom").distinct().withColumn("size", F.lit(MINUTES).cast("long"))


def sequences(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.upper(F.regexp_replace("text", "[^ACGTacgt]+", "")).alias("seq"))


def profiles(s: SparkSession, d: str) -> DataFrame:
    """id, label, pos, n: integer counts by position, long."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.posexplode("embedding").alias("pos", "x"))
    return e.select("id", "label", F.col("pos").cast("long").alias("pos"), F.floor(F.abs(F.col("x").cast("double")) * 1000).alias("n"))


def arrays(s: SparkSession, d: str) -> DataFrame:
    """id, label, a (counts), b (the shares of another count array: a reversed, each plus 1)."""
    e = table(s, d, "embeddings")
    a = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("double"))
    return e.select(F.col("vec_id").alias("id"), "label", a.alias("a")).withColumn("b", F.transform(F.reverse("a"), lambda x: x + 1))


def hits(s: SparkSession, d: str) -> DataFrame:
    """id, peak (user and day), key, start, end: an event each, ten minutes long."""
    return points(s, d).select("id", F.concat_ws("/", "user_id", F.floor(F.col("pos") / 1440)).alias("peak"), F.col("chrom").alias("key"), F.col("pos").alias("start"), (F.col("pos") + 10).alias("end"), F.col("value").alias("score"))


SQL = {
    "points": "select event_id as id, event_type as chrom, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 60000000 as pos, user_id, floor(value * 100)::bigint as value from events",
    "track": "select chrom, pos as lo, pos + 1 as hi, sum(value)::bigint as value from points group by all",
    "runs": "select chrom, lo, least(coalesce(lead(lo) over (partition by chrom order by lo), lo + 40), lo + 40) as hi, value from track",
    "loci": "select id, chrom, pos - 5 as st, pos + 5 as e, 5 as summit, value as signal, user_id from points",
    "regions": "select chrom, min(pos) as b_start, min(pos) + 30 as b_end, user_id as region from points group by chrom, user_id",
    "sizes": f"select distinct chrom, {MINUTES} as size from points",
    "windows": "select id, chrom, st + summit - 60 as lo, st + summit + 60 as hi, signal from loci where st + summit - 60 >= 0 and st + summit + 60 <= 43200",
    "sequences": "select doc_id as id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) as seq from documents",
    "profiles": "select vec_id as id, label, unnest(generate_series(0, len(embedding) - 1)) as pos, floor(abs(unnest(embedding)::double) * 1000)::bigint as n from embeddings",
    "pairs": "select p.id, p.label, p.pos, p.n::double as a, q.n::double + 1 as b from profiles p join profiles q on p.id = q.id and q.pos = (select max(pos) from profiles r where r.id = p.id) - p.pos",
    "hits": "select id, user_id || '/' || (pos // 1440) as peak, chrom as key, pos as lo, pos + 10 as hi, value as score from points",
}
NEEDS = {"track": ["points"], "runs": ["track"], "loci": ["points"], "regions": ["points"], "sizes": ["points"], "windows": ["loci"], "pairs": ["profiles"], "hits": ["points"]}


def with_views(query: str, *names: str) -> str:
    """The query after the views it names and those they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return query
    head = ", ".join(f"{n} as ({SQL[n]})" for n in order)
    q = query.strip()
    return f"with {head}, {q[5:]}" if q.startswith("with ") else f"with {head} {q}"
