"""Sources that plan their own partitions: FASTA by its index, and sorted bedGraph by blocks.

Both are Python data sources for spark.read.format(). A filter on the region reaches them
(with spark.sql.python.filterPushdown.enabled) and leaves only the partitions that can hold
rows of it, so a query for one region opens that region's bytes; Spark applies the filters
again. Bytes are read in place by pyarrow's file systems (local, S3, HDFS), and the driver
reads an index or the first line of each block, nothing else.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds


def opened(path: str):
    """A random-access file and its size."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = path[len("file:") :]
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name), system.get_file_info(name).size


@dataclass
class Region:
    """What filters leave: chromosomes (None: all), least and most of whole-number columns."""

    chroms: set | None = None
    least: dict | None = None
    most: dict | None = None

    def take(self, f: ds.Filter) -> None:
        name = f.attribute[0] if len(f.attribute) == 1 else None
        low, high = self.least, self.most
        if name == "chrom" and isinstance(f, ds.EqualTo | ds.In):
            values = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
            self.chroms = values if self.chroms is None else self.chroms & values
        elif name in ("start", "end", "chunk_id"):
            if isinstance(f, ds.EqualTo | ds.GreaterThanOrEqual | ds.GreaterThan):
                low[name] = max(low.get(name, f.value), f.value + isinstance(f, ds.GreaterThan))
            if isinstance(f, ds.EqualTo | ds.LessThanOrEqual | ds.LessThan):
                high[name] = min(high.get(name, f.value), f.value - isinstance(f, ds.LessThan))

    def of(self, chrom: str) -> bool:
        return self.chroms is None or chrom in self.chroms


class _Reader(ds.DataSourceReader):
    def __init__(self, options):
        self.options, self.region = options, Region(None, {}, {})

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if hasattr(f, "attribute"):
                self.region.take(f)
            yield f  # partitions are coarser than rows


@dataclass
class Letters(ds.InputPartition):
    chrom: str
    start: int  #: of the contig
    end: int
    first: int  #: the first letter's byte
    per_line: int
    line: int  #: bytes of a line with its end


class _FastaReader(_Reader):
    def partitions(self) -> list[Letters]:
        o, r = self.options, self.region
        chunk, span = int(o.get("chunk", 10_000)), int(o.get("span", 4_000_000))
        span = max(chunk, span // chunk * chunk)
        low = max(r.least.get("start", 0), r.least.get("chunk_id", 0) * chunk)
        top = min(r.most.get("start", 1 << 62), r.most.get("chunk_id", 1 << 50) * chunk)
        f, size = opened(o.get("index", f"{o['path']}.fai"))
        out = []
        with f:
            for line in f.read(size).decode().splitlines():
                chrom, length, first, per_line, width = line.split("\t")[:5]
                if not r.of(chrom):
                    continue
                length = int(length)
                for a in range(low // span * span, max(length, 1), span):
                    if a > top:
                        break
                    # whole chunks that start within the bounds
                    lo, hi = max(a, -(-low // chunk) * chunk), min(a + span, length, top // chunk * chunk + chunk)
                    if lo < hi or length == 0:
                        out.append(Letters(chrom, lo, hi, int(first), max(1, int(per_line)), max(1, int(width))))
        return out

    def read(self, p: Letters | None) -> Iterator[tuple]:
        if p is None:  # nothing was planned
            return
        chunk = int(self.options.get("chunk", 10_000))
        at = lambda i: p.first + i // p.per_line * p.line + i % p.per_line
        f, _ = opened(self.options["path"])
        with f:
            if p.start >= p.end:
                yield p.chrom, 0, 0, ""
            for a in range(p.start, p.end, chunk):
                b = min(a + chunk, p.end)
                raw = f.read_at(at(b - 1) + 1 - at(a), at(a))
                yield p.chrom, a // chunk, a, raw.translate(None, b"\r\n").decode().upper()


class FastaRanges(ds.DataSource):
    """Options path, index (path.fai), chunk (letters a row), span (letters a partition): rows chrom, chunk_id, start, seq."""

    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return "chrom string, chunk_id long, start long, seq string"

    def reader(self, schema):
        return _FastaReader(self.options)


@dataclass
class Lines(ds.InputPartition):
    start: int
    end: int


class _BedGraphReader(_Reader):
    def partitions(self) -> list[Lines]:
        r, block = self.region, int(self.options.get("block", 16 << 20))
        f, size = opened(self.options["path"])
        with f:
            cuts = [*range(0, size, block)]
            heads = [head for head in (_head(f, a, size) for a in cuts) if head]
        heads = [h for i, h in enumerate(heads) if not i or h[0] > heads[i - 1][0]]
        out = []
        for i, (a, chrom, start) in enumerate(heads):
            b, next_chrom, upto = heads[i + 1] if i + 1 < len(heads) else (size, None, None)
            whole = chrom == next_chrom
            # where the chromosome changes, another one may begin and end
            if r.chroms is not None and chrom not in r.chroms and whole:
                continue
            if whole and (start > r.most.get("start", start) or upto < r.least.get("start", upto) or upto < r.least.get("end", upto)):
                continue
            out.append(Lines(a, b))
        return out

    def read(self, p: Lines | None) -> Iterator:
        if p is None:
            return
        import io

        import pyarrow as pa
        from pyarrow import csv

        f, _ = opened(self.options["path"])
        with f:
            raw = f.read_at(p.end - p.start, p.start)
        kept = raw if not p.start == 0 else b"\n".join(x for x in raw.split(b"\n") if not x.startswith((b"#", b"track", b"browser")))
        if not kept.strip():
            return
        kinds = {"chrom": pa.string(), "start": pa.int64(), "end": pa.int64(), "value": pa.float64()}
        sep = "\t" if b"\t" in kept[: 1 << 16] else " "
        table = csv.read_csv(io.BytesIO(kept), csv.ReadOptions(column_names=list(kinds)), csv.ParseOptions(delimiter=sep), csv.ConvertOptions(column_types=kinds, null_values=["."]))
        yield from table.to_batches()


def _head(f, a: int, size: int) -> tuple[int, str, int] | None:
    """The first line that begins at byte a or after, as its byte, chromosome and start; comments are passed over at the file's beginning."""
    at, width = a, 1 << 12
    while at < size:
        raw = f.read_at(min(width, size - at + 1), max(at - 1, 0))
        skip = 0 if at == 0 else raw.find(b"\n") + 1
        if at and not skip:
            if at - 1 + len(raw) >= size:
                return None
            width *= 2
            continue
        end = raw.find(b"\n", skip)
        if end < 0 and max(at - 1, 0) + len(raw) < size:
            width *= 2
            continue
        line = raw[skip : end if end >= 0 else len(raw)]
        byte = max(at - 1, 0) + skip
        if byte >= size:
            return None
        if line.strip() and not line.startswith((b"#", b"track", b"browser")):
            chrom, start = line.split(None, 2)[:2]
            return (0 if a == 0 else byte), chrom.decode(), int(start)
        at = byte + len(line) + 1
    return None


class BedGraphRanges(ds.DataSource):
    """Options path and block (bytes a partition): rows chrom, start, end, value of a bedGraph in which chromosomes are whole and runs sorted without overlaps."""

    @classmethod
    def name(cls) -> str:
        return "bedgraph_ranges"

    def schema(self) -> str:
        return "chrom string, start long, end long, value double"

    def reader(self, schema):
        return _BedGraphReader(self.options)


def register(spark: SparkSession) -> None:
    """Both sources, and filters that reach them, for a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FastaRanges, BedGraphRanges):
        spark.dataSource.register(source)


def read_fasta_ranges(spark: SparkSession, path: str, **options):
    register(spark)
    return spark.read.format("fasta_ranges").options(path=path, **options).load()


def read_bedgraph_ranges(spark: SparkSession, path: str, **options):
    register(spark)
    return spark.read.format("bedgraph_ranges").options(path=path, **options).load()


def write_fasta_index(spark: SparkSession, path: str, index: str) -> None:
    """The .fai of a FASTA file: name, length, first byte, letters and bytes a line of each contig.

    Lines get their bytes from running sizes within blocks of the file, so no task reads it
    all; the index itself, a line a contig, is written by one task.
    """
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    # a carriage return counts as a byte of the line, not as a letter
    sized = lines.select("block", "at", (F.octet_length("value") + 1).alias("bytes"), F.length(F.rtrim(F.regexp_replace("value", "\r$", ""))).alias("letters"), F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("name"))
    before = W.partitionBy("block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    blocks = sized.groupBy("block").agg(F.sum("bytes").alias("n"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col("at"))).alias("name"), F.max(F.when(F.col("name").isNotNull(), F.col("at"))).alias("head"))
    upto = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row a block of the file
    shift = blocks.select("block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_n"), F.last("head", ignorenulls=True).over(upto).alias("_head"))
    own = F.max(F.when(F.col("name").isNotNull(), F.col("at"))).over(W.partitionBy("block").orderBy("at"))
    placed = sized.withColumn("_o", F.coalesce(F.sum("bytes").over(before), F.lit(0))).withColumn("_own", own).join(F.broadcast(shift), "block").select("at", "bytes", "letters", "name", (F.col("_o") + F.col("_n")).alias("byte"), F.coalesce("_own", "_head").alias("of"))
    line = placed.filter("name is null and of is not null")
    contigs = placed.filter("name is not null").select(F.col("at").alias("of"), "name", (F.col("byte") + F.col("bytes")).alias("first"))
    widths = line.groupBy("of").agg(F.sum("letters").alias("length"), F.min_by("letters", "at").alias("per_line"), F.min_by("bytes", "at").alias("width"))
    out = contigs.join(widths, "of", "left").fillna(0, ["length", "per_line", "width"])
    out.orderBy("of").select("name", "length", "first", "per_line", "width").coalesce(1).write.mode("overwrite").option("sep", "\t").csv(index)
