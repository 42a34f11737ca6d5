"""From loci to metrics through any scorer: tensors of sequences in Arrow batches, both strands averaged, predicted profiles and counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import profile as pf
from . import predictions, tracks
from .assembly import fetched

#: Takes one-hot tensors (n, length, 4); returns logits (n, out, strands) and log counts (n, 1) or (n, strands).
Scorer = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
CODE = np.full(256, 4, np.uint8)
for _i, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    CODE[list(_pair)] = _i
#: The letters of nucleotides and of what stands for several of them.
KNOWN = b"ACGTNYRMSWK"


def tensor(seqs: list[str], length: int, strict: bool = False) -> np.ndarray:
    """One-hot sequences (n, length, 4), cut or filled with N to length; letters other than ACGT are zero, or with strict an error if they aren't known ones."""
    text = "".join(s[:length].ljust(length, "N") for s in seqs).encode("latin-1", "replace")
    if strict and (bad := set(text.upper()) - set(KNOWN)):
        raise ValueError(f"letters that are no bases: {bytes(sorted(bad)).decode('latin-1')}")
    x = np.zeros((len(text), 5), np.float32)
    x[np.arange(len(text)), CODE[np.frombuffer(text, np.uint8)]] = 1
    return x[:, :4].reshape(len(seqs), length, 4)


def both_strands_scored(scorer: Scorer, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits and log counts, averaged with those of the reverse complement, turned back."""
    logits, counts = (np.asarray(y, np.float64) for y in scorer(x))
    back, back_counts = (np.asarray(y, np.float64) for y in scorer(np.ascontiguousarray(x[:, ::-1, ::-1])))
    return (logits + back[:, ::-1, ::-1]) / 2, (counts + back_counts[:, ::-1]) / 2


def profiles(logits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predicted profiles (n, out, strands) and their log counts: shares over both strands times the one count, or strand by strand where each has a count."""
    axes = (1, 2) if counts.shape[1] == 1 else (1,)
    shares = np.exp(logits - logits.max(axis=axes, keepdims=True))
    shares /= shares.sum(axis=axes, keepdims=True)
    p = shares * np.exp(counts)[:, None, :]
    return p, np.log(p.sum(axis=1)) if counts.shape[1] == 1 else counts


def predicted(examples: DataFrame, scorer: Scorer, length: int, average: bool = True, window: int | None = None, rows: int = 256, column: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """examples (id, seq) as id, strand, predicted, predicted_log_count: the scorer is called with rows sequences at a time; window: how much of the middle of the profiles stays; keep: columns that come along.

    Null sequences are all N; an empty table gives no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x = tensor([s or "" for s in part.column(1).to_pylist()], length)
                logits, counts = both_strands_scored(scorer, x) if average else (np.asarray(y, np.float64) for y in scorer(x))
                p, logs = profiles(logits, counts)
                n, out, strands = p.shape
                low = 0 if window is None else out // 2 - window // 2
                p = p[:, low : None if window is None else low + window].transpose(0, 2, 1)
                values = pa.ListArray.from_arrays(pa.array(np.arange(n * strands + 1, dtype=np.int32) * p.shape[2]), pa.array(np.ascontiguousarray(p).ravel()))
                each = pa.array(np.repeat(np.arange(n), strands))
                rest = [part.column(i).take(each) for i in range(2, 2 + len(keep))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(each), pa.array(np.tile(np.arange(strands, dtype=np.int32), n)), values, pa.array(np.ascontiguousarray(logs).ravel()), *rest], names=["id", "strand", "predicted", "predicted_log_count", *keep])

    kind = {c: examples.schema[c].dataType.simpleString() for c in ("id", *keep)}
    more = "".join(f", {c} {kind[c]}" for c in keep)
    return examples.select("id", column, *keep).mapInArrow(run, f"id {kind['id']}, strand int, predicted array<double>, predicted_log_count double{more}")


def truths(loci: DataFrame, strands: list[DataFrame], size: int = tracks.CHUNK) -> DataFrame:
    """id, strand, truth, true_log_count (of the sum plus one) of each locus (id, chrom, start, end) from a track for each strand."""
    x = tracks.stacked(loci, strands, size).select("id", F.posexplode("profiles").alias("strand", "truth"))
    return x.withColumn("true_log_count", F.log1p(pf.total(F.col("truth"))))


def evaluated(loci: DataFrame, chunks: DataFrame, size: int, strands: list[DataFrame], scorer: Scorer, flank: int = 0, average: bool = True, window: int | None = None, width: int = 1, **metrics) -> DataFrame:
    """The whole chain as one lazy query: loci (id, chrom, start, end; of one width) to predictions and metrics (id, strand, truth, predicted, log counts, jsd, cross_entropy, mse, pearson, spearman).

    Of loci with equal chrom and start the first id counts. The scorer sees width letters,
    flank of them before the locus; profiles and truth are cut to the window in the middle.
    Strands are tracks of runs, or of chunks of tracks.CHUNK places as stacked() takes them. The
    truth meets the sequence, a row a locus, and goes through the scorer beside it: each locus is
    scored once, and what follows needs no shuffle.
    """
    rest = F.min_by(F.struct("id", "end"), "id").alias("r")
    once = loci.groupBy("chrom", "start").agg(rest).select("r.id", "chrom", "start", "r.end")
    wide = once.select("id", "chrom", (F.col("start") - flank).alias("start"), (F.col("start") - flank + width).alias("end"))
    examples = fetched(wide, chunks, size).select("id", "seq").join(tracks.stacked(once, strands).hint("merge"), "id")
    p = predicted(examples, scorer, width, average, window, keep=("profiles",))
    t = p.withColumn("truth", F.get("profiles", "strand")).filter("truth is not null").drop("profiles")
    t = t.withColumn("true_log_count", F.log1p(pf.total(F.col("truth"))))
    if window is not None:
        t = t.withColumn("truth", F.slice("truth", F.floor(F.size("truth") / 2).cast("int") - window // 2 + 1, window))
    keys = ("id", "strand", "truth", "true_log_count", "predicted", "predicted_log_count")
    return predictions.metrics(t, keys=keys, **metrics)


def through_tensors(examples: DataFrame, column: str = "seq") -> DataFrame:
    """examples (id, seq) as one-hot tensors and back: id, back (N for what is no base), and how many of each base the tensor holds (n_a, n_c, n_g, n_t)."""
    letters = np.frombuffer(b"ACGTN", np.uint8)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            back, counts = [], []
            for s in batch.column(1).to_pylist():
                x = tensor([s or ""], len(s or ""))[0]
                back.append(letters[np.where(x.any(axis=1), x.argmax(axis=1), 4)].tobytes().decode())
                counts.append(x.sum(axis=0).astype(np.int64))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string()), *(pa.array(n[:, i].copy()) for i in range(4))], names=["id", "back", "n_a", "n_c", "n_g", "n_t"])

    kind = examples.schema["id"].dataType.simpleString()
    return examples.select("id", column).mapInArrow(run, f"id {kind}, back string, n_a long, n_c long, n_g long, n_t long")
