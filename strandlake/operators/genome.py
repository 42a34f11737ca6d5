"""Base counts of genome windows, from sequences in chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as sq
from .tracks import pieces


def nominal_percent(count: Column, width: int) -> Column:
    """Whole percent of a window's nominal width, halves up, however much of it lies on the contig."""
    return F.floor((F.lit(200) * count + width) / (2 * width))


def bin_counts(chunks: DataFrame, width: int, stride: int, letters: str = "GC") -> DataFrame:
    """chrom, start, n: how many of the letters windows of a width have that start each stride; windows that no chunk touches are left out.

    chunks: chrom, start, seq. Letters are added up once along a chunk; what a window has of
    the chunk is then the difference of two of these sums, so there is a row for each window
    and chunk that meet, and none for a base.
    """
    table = np.zeros(256, bool)
    table[list((letters.upper() + letters.lower()).encode())] = True

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            first = batch.column(1).to_numpy(zero_copy_only=False)
            for i, (a, seq) in enumerate(zip(first.tolist(), batch.column(2).to_pylist(), strict=True)):
                if not seq:
                    continue
                upto = np.concatenate([[0], np.cumsum(table[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)])])
                b = a + len(seq)
                starts = np.arange(max(0, -((width - 1 - a) // stride)), (b - 1) // stride + 1) * stride
                n = upto[np.minimum(starts + width - a, len(seq))] - upto[np.maximum(starts - a, 0)]
                for k in range(0, len(starts), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i]] * len(starts[part]), batch.column(0).type), pa.array(starts[part]), pa.array(n[part])], names=["chrom", "start", "n"])

    kind = chunks.schema["chrom"].dataType.simpleString()
    found = chunks.select("chrom", F.col("start").cast("long").alias("start"), "seq").mapInArrow(run, f"chrom {kind}, start long, n long")
    return found.groupBy("chrom", "start").agg(F.sum("n").alias("n"))


def gc_bins(chunks: DataFrame, sizes: DataFrame, width: int, stride: int) -> DataFrame:
    """chrom, start, end, n (of G and C), gc (whole percent of the width): every window that starts on a chromosome, its end not cut."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(stride).cast("long"))).alias("start")
    every = sizes.filter("size > 0").select("chrom", at)
    n = F.coalesce("n", F.lit(0).cast("long"))
    return every.join(bin_counts(chunks, width, stride), ["chrom", "start"], "left").select("chrom", "start", (F.col("start") + width).alias("end"), n.alias("n"), nominal_percent(n, width).alias("gc"))


def base_counts(loci: DataFrame, chunks: DataFrame, size: int, letters: str = "GC") -> DataFrame:
    """id, n: how many of the letters each locus (id, chrom, start, end) has on its contig, counted within the chunks that it touches."""
    piece = F.expr("substring(seq, _a + 1, _b - _a)")
    met = pieces(loci, size, ["id"]).join(chunks.select("chrom", "chunk_id", "seq"), ["chrom", "chunk_id"])
    n = met.groupBy("id").agg(F.sum(sq.base_count(F.upper(piece), letters)).alias("n"))
    return loci.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def position_counts(sequences: DataFrame, keys: list[str]) -> DataFrame:
    """keys (whole numbers), pos, base, n: how often each base stands at each position of sequences (keys, seq), per value of the keys.

    Letters are counted within Arrow batches, so what is shuffled is a row for each key,
    position and base of a batch, not for each letter. Some LETTERS are counted at a time, and
    counts are given out whenever there are as many, so no task holds more, however long texts are.
    """

    def counted(found: list, counts: list) -> tuple:
        """Columns of cells (keys, position, letter) and their numbers, each cell once."""
        cells, n = np.concatenate(found, axis=1), np.concatenate(counts)
        order = np.lexsort(cells[::-1])
        cells, n = cells[:, order], n[order]
        new = np.flatnonzero(np.append(True, (cells[:, 1:] != cells[:, :-1]).any(axis=0)))[: cells.shape[1]]
        return cells[:, new], np.add.reduceat(n, new) if len(new) else n

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def given(cells: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            bases = pa.array([chr(b) for b in cells[-1].tolist()], pa.string())
            return pa.RecordBatch.from_arrays([*(pa.array(f) for f in cells[:-1]), bases, pa.array(n)], names=[*keys, "pos", "base", "n"])

        for batch in batches:
            values = np.array([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(keys))], np.int64).reshape(len(keys), batch.num_rows)
            cells, n = np.zeros((len(keys) + 2, 0), np.int64), np.zeros(0, np.int64)
            for text, at, rows in _parts(batch.column(len(keys)), LETTERS):
                own = np.concatenate([values[:, rows], at[None], text[None]])
                cells, n = counted([cells, own], [n, np.ones(len(text), np.int64)])
                if len(n) >= LETTERS:
                    yield given(cells, n)
                    cells, n = cells[:, :0], n[:0]
            yield given(cells, n)

    schema = "".join(f"`{k}` long, " for k in keys) + "pos long, base string, n long"
    rows = sequences.select(*(F.col(k).cast("long").alias(k) for k in keys), "seq").mapInArrow(run, schema)
    return rows.groupBy(*keys, "pos", "base").agg(F.sum("n").alias("n"))


#: Letters that are counted at a time.
LETTERS = 1 << 18


def _parts(seqs, most: int) -> Iterator[tuple]:
    """An Arrow column of texts as arrays of up to most letters, their positions and their rows; long texts are cut."""
    letters, at, rows, size = [], [], [], 0
    for row in range(len(seqs)):
        text = np.frombuffer((seqs[row].as_py() or "").encode("latin-1", "replace"), np.uint8)
        k = 0
        while k < len(text):
            part = text[k : k + most - size]
            letters.append(part)
            at.append(np.arange(k, k + len(part)))
            rows.append(np.full(len(part), row))
            k, size = k + len(part), size + len(part)
            if size == most:
                yield np.concatenate(letters).astype(np.int64), np.concatenate(at), np.concatenate(rows)
                letters, at, rows, size = [], [], [], 0
    if size:
        yield np.concatenate(letters).astype(np.int64), np.concatenate(at), np.concatenate(rows)


def base_shares(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos and the share of each base A, C, G, T of position_counts()."""
    share = [(F.sum(F.when(F.col("base") == b, F.col("n")).otherwise(0)) / F.sum("n")).alias(b) for b in "ACGT"]
    return counts.groupBy(*keys, "pos").agg(*share)
