"""Readers and writers of the text formats; all lazy, with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import schemas


def _tsv(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    return spark.read.schema(schema).options(sep="\t", nullValue=".", **options).csv(path)


def read_narrow_peak(spark: SparkSession, path: str) -> DataFrame:
    """Ten columns without a header; '.' is null; gzip by the file's name."""
    return _tsv(spark, path, schemas.NARROW_PEAK)


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, schemas.CHROM_SIZES)


def read_bed3(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, schemas.BED3)


def read_gc_bed(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, schemas.BED4)


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, schemas.TRACK)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, schemas.HIT)


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Motif scanner rows as they stand (name, motif, pos, strand, score, match, rest), and in bad the whole line where it doesn't parse."""
    schema = "name string, motif string, pos long, strand string, score double, match string, rest string, bad string"
    # the scanner ends lines in a comma or not
    df = spark.read.schema(schema).options(mode="PERMISSIVE", columnNameOfCorruptRecord="bad").csv(path)
    parsed = F.col("name").rlike("^[^:]+:[0-9]+-[0-9]+") & F.col("pos").isNotNull() & F.col("score").isNotNull() & F.col("match").isNotNull()
    # a line with one field less or more than the schema is marked too, though all it needs is there
    line = F.coalesce("bad", F.concat_ws(",", "name", "motif", F.col("pos").cast("string"), "strand", F.col("score").cast("string"), "match"))
    return df.withColumn("bad", F.when(~F.coalesce(parsed, F.lit(False)), line))


def bad_scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that read_scan_csv() leaves out."""
    return scan_lines(spark, path).filter("bad is not null").select("bad")


def read_scan_csv(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Motif scanner rows (sequence name, motif file, place, strand, score, match) as hits.

    Lines that don't parse are left out, and bad_scan_lines() has them; with strict they make
    the query fail.
    """
    raw = scan_lines(spark, path)
    if strict:
        raw = raw.withColumn("bad", F.when(F.col("bad").isNotNull(), F.raise_error(F.concat(F.lit("bad line: "), "bad")).cast("string")))
    raw = raw.filter("bad is null")
    at = F.split("name", "[:-]")
    start = at[1].cast("long") + F.col("pos")
    return raw.select(at[0].alias("chrom"), start.alias("start"), (start + F.length("match")).alias("end"), F.regexp_replace("motif", r"\.pfm$", "").alias("key"), "strand", "score")


#: Columns of a motif similarity table, and their types.
SIMILARITY = {"Query_ID": "string", "Target_ID": "string", "Optimal_offset": "long", "p-value": "double", "E-value": "double", "q-value": "double", "Overlap": "long", "Query_consensus": "string", "Target_consensus": "string", "Orientation": "string"}


def read_similarity(spark: SparkSession, path: str) -> DataFrame:
    """A similarity table with a header, comments left out; numbers are numbers, other columns text, whatever their order."""
    raw = spark.read.options(sep="\t", header="true", comment="#").csv(path)
    # text that is no number is an error, as it would be in a schema
    return raw.select(*(F.col(f"`{c}`").cast(SIMILARITY.get(c, "string")).alias(c) for c in raw.columns))


def read_fasta(spark: SparkSession, path: str, chunk: int = 10_000) -> DataFrame:
    """chrom, chunk_id, start, seq: fixed-size chunks, upper case; an empty contig has one of no letters. operators.assembly.fetched() reads ranges.

    Lines get their places from running lengths within each block of a file, shifted by a
    table of a row a block, so a contig is spread over the blocks that hold it. What stands
    before the first name is left out. Only a contig written as one line is one row.
    """
    here, line = ["file", "block"], F.col("value")
    block = W.partitionBy(*here).orderBy("at")
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    name = F.when(line.startswith(">"), F.regexp_extract(line, r"^>\s*(\S*)", 1))
    rows = lines.select(*here, "at", name.alias("name"), F.when(name.isNull(), F.upper(F.regexp_replace(line, r"\s+", ""))).otherwise("").alias("letters"))
    before = rows.groupBy(*here).agg(F.sum(F.length("letters")).alias("n")).select(*here, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    run = F.coalesce(F.sum(F.length("letters")).over(block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("run", run).join(before, here).withColumn("place", F.col("run") + F.col("before"))
    contig = placed.withColumn("head", F.when(F.col("name").isNotNull(), F.struct(F.col("place").alias("from"), "name")))
    carried = contig.groupBy(*here).agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("at"))).alias("carried"))
    carried = carried.withColumn("carried", F.last("carried", ignorenulls=True).over(earlier))
    own = F.last("head", ignorenulls=True).over(block.rowsBetween(W.unboundedPreceding, 0))
    of = contig.withColumn("own", own).join(carried, here).withColumn("of", F.coalesce("own", "carried")).filter("of is not null and (name is not null or letters <> '')")
    # pieces of a chunk's length at most lie in two chunks at most
    pieces = F.when(F.col("name").isNotNull(), F.array(F.lit(""))).otherwise(F.regexp_extract_all("letters", F.lit(f"(.{{1,{chunk}}})"), F.lit(1)))
    cut = of.select("file", "of", (F.col("place") - F.col("of.from")).alias("start"), F.posexplode(pieces).alias("k", "piece")).withColumn("start", F.col("start") + F.col("k") * chunk)
    last = F.floor((F.col("start") + F.greatest(F.length("piece"), F.lit(1)) - 1) / chunk)
    each = cut.select("*", F.explode(F.sequence(F.floor(F.col("start") / chunk), last)).alias("chunk_id"))
    skip = F.greatest(F.col("chunk_id") * chunk - F.col("start"), F.lit(0))
    part = F.substring("piece", (skip + 1).cast("int"), F.least(F.lit(chunk), (F.col("chunk_id") + 1) * chunk - F.col("start")).cast("int"))
    whole = each.groupBy("file", "of", "chunk_id").agg(F.array_sort(F.collect_list(F.struct((F.col("start") + skip).alias("at"), part.alias("s")))).alias("parts"))
    return whole.select(F.col("of.name").alias("chrom"), "chunk_id", (F.col("chunk_id") * chunk).alias("start"), F.array_join(F.transform("parts", lambda x: x["s"]), "").alias("seq"))


def read_meme(spark: SparkSession, path: str) -> DataFrame:
    """motif, pos, a, c, g, t: the probability rows of a motif database in minimal MEME format."""
    text = spark.read.option("lineSep", "MOTIF ").text(path).withColumn("rows", F.split("value", "\n")).filter("value like '%letter-probability matrix%'")
    motif = F.split(F.trim(F.col("rows")[0]), r"\s+")[0].alias("motif")
    number = r"^\s*[0-9.eE+-]+(\s+[0-9.eE+-]+){3}\s*$"
    out = text.select(motif, F.posexplode(F.filter("rows", lambda r: r.rlike(number))).alias("pos", "r")).withColumn("v", F.split(F.trim("r"), r"\s+"))
    return out.select("motif", "pos", *(F.col("v")[i].cast("double").alias(b) for i, b in enumerate("acgt")))


def read_indices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter("trim(value) <> ''").select(F.trim("value").cast("long").alias("row_idx"))


def read_text(path: str) -> str:
    """A small file as one text, by Spark's readers, so from any store that they reach."""
    spark = SparkSession.builder.getOrCreate()
    rows = spark.read.text(path, wholetext=True).collect()  # a file of settings
    if len(rows) > 1:
        raise ValueError(f"{path} holds {len(rows)} files")
    return rows[0][0] if rows else ""


def write_text(text: str, path: str) -> None:
    """text as the one file of a folder, which read_text() takes."""
    spark = SparkSession.builder.getOrCreate()
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_tasks(path: str) -> dict:
    """The task tree; numeric keys become integers."""
    return {int(k) if k.isdigit() else k: v for k, v in json.loads(read_text(path)).items()}


def read_splits(path: str) -> dict:
    return json.loads(read_text(path))


def with_defaults(given: dict, defaults: dict) -> dict:
    """given over defaults, key by key; neither is changed."""
    return {**defaults, **{k: with_defaults(v, defaults[k]) if isinstance(v, dict) and isinstance(defaults.get(k), dict) else v for k, v in given.items()}}


def write_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").options(sep="\t", nullValue=".", emptyValue="").csv(path)


def write_narrow_peak(df: DataFrame, path: str) -> None:
    write_tsv(df, path, [c.split()[0] for c in schemas.NARROW_PEAK.split(", ")])


def write_bedgraph(df: DataFrame, path: str) -> None:
    write_tsv(df, path, ["chrom", "start", "end", "value"])


def write_meme(motifs: DataFrame, path: str) -> None:
    """motif, pos, a, c, g, t as minimal MEME text, a block for each motif."""
    row = F.format_string("%.6f %.6f %.6f %.6f", "a", "c", "g", "t")
    blocks = motifs.groupBy("motif").agg(F.array_sort(F.collect_list(F.struct("pos", row.alias("r")))).alias("rows"))
    text = F.concat(F.lit("MOTIF "), "motif", F.lit("\nletter-probability matrix: alength= 4 w= "), F.size("rows").cast("string"), F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["r"]), "\n"), F.lit("\n"))
    blocks.select(text.alias("value")).write.mode("overwrite").text(path)
