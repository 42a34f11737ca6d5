"""Stores of predictions, attributions, embeddings, motifs, metrics and runs: Parquet tables, and JSON for a run's settings."""

from __future__ import annotations

import json
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import profile as pf
from ..operators.motifs import trimmed
from .files import read_text, write_text

PREDICTIONS = "chrom string, start long, end long, track int, true_profile array<double>, true_log_count double, predicted_profile array<double>, predicted_log_count double"
ATTRIBUTIONS = "chrom string, start long, end long, attribution_index long, hot array<array<int>>, scores array<array<double>>"
EMBEDDINGS = "chrom string, start long, end long, layer string, embedding array<double>"
ENSEMBLES = PREDICTIONS + ", members int"
MOTIFS = "metacluster int, pattern int, pos int, a double, c double, g double, t double, contrib_a double, contrib_c double, contrib_g double, contrib_t double"
METRICS = "metric string, strand string, example long, value double"


def _names(schema: str) -> list[str]:
    import re

    return re.findall(r"(?:^|, )(\w+) ", schema)


def write_store(df: DataFrame, path: str, schema: str) -> None:
    """The schema's columns, sorted within files by coordinates, so that readers by chromosome skip files' parts."""
    columns = _names(schema)
    by = [c for c in ("chrom", "start") if c in columns]
    out = df.select(*columns)
    (out.sortWithinPartitions(*by) if by else out).write.mode("overwrite").parquet(path)


def read_predictions(spark: SparkSession, *paths: str) -> DataFrame:
    """One or more stores as members of an ensemble: with member, a number by the order of paths."""
    parts = [spark.read.schema(PREDICTIONS).parquet(p).withColumn("member", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_attributions(spark: SparkSession, path: str, centre: int | None = None, chroms: list[str] | None = None, only_acgt: bool = False) -> DataFrame:
    """Attributions, of some chromosomes, cut to their centre, without those in which a position has no base. Only the columns asked for are read."""
    df = spark.read.schema(ATTRIBUTIONS).parquet(path)
    if chroms is not None:
        df = df.filter(F.col("chrom").isin(chroms))
    if centre is not None:
        df = df.withColumns({c: pf.centre_cut(F.col(c), centre) for c in ("hot", "scores")})
    return df.filter(F.forall("hot", lambda r: F.array_max(r) == 1)) if only_acgt else df


def mean_attributions(members: DataFrame) -> DataFrame:
    """Members' attributions averaged, NaN left out, where all members have the coordinates."""
    n = members.select("member").distinct().count()
    keys = ["chrom", "start", "end"]
    whole = members.groupBy(*keys).agg(F.countDistinct("member").alias("_m")).filter(F.col("_m") == n).drop("_m")
    long = members.select(*keys, F.posexplode("scores").alias("pos", "row")).select(*keys, "pos", F.posexplode("row").alias("base", "x"))
    mean = long.groupBy(*keys, "pos", "base").agg(F.avg(F.when(~F.isnan("x"), F.col("x"))).alias("score"))
    return mean.join(whole, keys)


def motifs_of(df: DataFrame) -> DataFrame:
    """Motif rows (motif, pos, a, c, g, t of contributions) of motifs whose total contribution is not negative."""
    total = df.groupBy("motif").agg(F.sum(F.col("a") + F.col("c") + F.col("g") + F.col("t")).alias("_t")).filter("_t >= 0")
    return df.join(total.select("motif"), "motif", "left_semi")


def write_pfm(df: DataFrame, path: str) -> None:
    """motif, pos, a, c, g, t as one folder of text for each motif: a line a base, a number a position."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.format_string("%.6f", "x").alias("x")))), lambda p: p["x"]), " ")
    base = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.col(b).alias("x")) for i, b in enumerate("acgt"))))
    rows = df.select("motif", "pos", base.alias("b")).select("motif", "pos", "b.k", "b.x").groupBy("motif", "k").agg(line.alias("value"))
    text = rows.groupBy("motif").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda r: r["value"]), "\n").alias("value"))
    text.write.mode("overwrite").partitionBy("motif").text(path)


def write_gc_bed(df: DataFrame, path: str) -> None:
    """chrom, st, end and gc (whole percent) as BED4 with two decimals."""
    df.select("chrom", "st", "end", F.format_string("%.2f", F.col("gc") / 100)).write.mode("overwrite").option("sep", "\t").csv(path)


def folds(splits: dict, chroms: list[str]) -> dict[str, dict[str, list[str]]]:
    """Each fold's chromosomes: validation and test as given, train as given or all others."""
    out = {}
    for name, fold in splits.items():
        val, test = fold.get("val", []), fold.get("test", [])
        out[name] = {"train": fold.get("train") or [c for c in chroms if c not in {*val, *test}], "val": val, "test": test}
    return out


def run_tag(now: datetime, zone: str = "UTC") -> str:
    """A time as a folder's name, in a zone."""
    return now.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d_%H_%M_%S")


def time_tag(utc: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(utc, zone), "yyyy-MM-dd_HH_mm_ss")


def write_run(path: str, config: dict, history: list[dict]) -> None:
    """A run's settings and its history, a row an epoch, as one JSON file in a folder."""
    write_text(json.dumps({"config": config, "history": history}, sort_keys=True), path)


def read_run(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    found = json.loads(read_text(path))
    return found["config"], spark.createDataFrame([(int(r["epoch"]), float(r["loss"])) for r in found["history"]], "epoch long, loss double")


def read_metrics(spark: SparkSession, path: str, metrics: list[str] | None = None) -> DataFrame:
    """metric, values: each metric over all its examples, the strands' values one after the other; of the metrics of counts, a value a strand.

    Values are in the order of strand and example; a metric's array is as long as its
    examples, so for tables too long for that use the rows themselves (METRICS).
    """
    df = spark.read.schema(METRICS).parquet(path)
    df = df if metrics is None else df.filter(F.col("metric").isin(metrics))
    rows = F.array_sort(F.collect_list(F.struct("strand", "example", "value")))
    return df.groupBy("metric").agg(rows.alias("r")).select("metric", F.transform("r", lambda r: r["value"]).alias("values"))


def metrics_by_strand(spark: SparkSession, path: str) -> DataFrame:
    """metric, strand, n, least, middle, most of stored metrics."""
    df = spark.read.schema(METRICS).parquet(path)
    return df.groupBy("metric", "strand").agg(F.count("value").alias("n"), F.min("value").alias("least"), F.percentile("value", 0.5).alias("middle"), F.max("value").alias("most"))


def read_motifs(spark: SparkSession, path: str, only_positive: bool = True, trim: float | None = None) -> DataFrame:
    """Discovered motifs (MOTIFS) as motif (group_pattern), pos, base shares and contributions.

    By default those whose contributions add up to less than 0 are left out; trim cuts each to
    the positions from the first to the last whose information content is trim or more.
    """
    df = spark.read.schema(MOTIFS).parquet(path)
    df = df.withColumn("motif", F.concat_ws("_", "metacluster", "pattern")).drop("metacluster", "pattern")
    if only_positive:
        kept = df.groupBy("motif").agg(F.sum(sum((F.col(f"contrib_{b}") for b in "acgt"), F.lit(0.0))).alias("_t")).filter("_t >= 0")
        df = df.join(kept.select("motif"), "motif", "left_semi")
    if trim is not None:
        ic = df.withColumn("ic", pf.information_content([F.col(b) for b in "acgt"])).withColumnRenamed("motif", "key")
        df = trimmed(ic, trim).drop("ic").withColumnRenamed("key", "motif")
    return df.select("motif", "pos", *"acgt", *(f"contrib_{b}" for b in "acgt"))


def write_ensemble(members: DataFrame, path: str) -> None:
    """Ensembles of predictions (ENSEMBLES): per coordinate and track the mean profile, its log count, and how many members it has."""
    write_store(members, path, ENSEMBLES)


def read_ensemble(spark: SparkSession, path: str, least_members: int = 1) -> DataFrame:
    """Ensembles of as many members or more."""
    return spark.read.schema(ENSEMBLES).parquet(path).filter(F.col("members") >= least_members)


def ensembled(members: DataFrame) -> DataFrame:
    """Predictions of members (PREDICTIONS with member) as ENSEMBLES: profiles' geometric means over all members' shares, times the exponent of the mean log count.

    Coordinates that not all members have are left out; the truth is that of the first member.
    """
    keys = ["chrom", "start", "end", "track"]
    total = members.agg(F.countDistinct("member").alias("_all"))
    whole = members.groupBy(*keys).agg(F.countDistinct("member").alias("members"), F.avg("predicted_log_count").alias("predicted_log_count"), F.min_by(F.struct("true_profile", "true_log_count"), "member").alias("t"))
    whole = whole.join(F.broadcast(total)).filter("members = _all")
    cells = members.select(*keys, "member", F.posexplode(pf.shares(F.col("predicted_profile"))).alias("pos", "p"))
    mean = cells.groupBy(*keys, "pos").agg(F.when(F.min("p") > 0, F.exp(F.avg(F.log("p")))).otherwise(0.0).alias("g"))
    arrays = mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("g", F.lit(0.0)).alias("g")))), lambda x: x["g"]).alias("g"))
    sums = F.aggregate("g", F.lit(0.0), lambda a, x: a + x)
    out = whole.join(arrays, keys).withColumn("_s", sums)
    profile = F.transform("g", lambda x: x / F.col("_s") * F.exp("predicted_log_count"))
    return out.select(*keys, F.col("t.true_profile").alias("true_profile"), F.col("t.true_log_count").alias("true_log_count"), profile.alias("predicted_profile"), "predicted_log_count", F.col("members").cast("int").alias("members"))
