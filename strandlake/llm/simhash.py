"""SimHash near-duplicates by covering-code anchors.

A document's 64-bit fingerprint: the majority of the XXH64 values (seed 42) of its
4-word shingles, bit by bit. Fingerprints link at DISTANCE = 4 or fewer differing bits.

Search. The fingerprint is read as two halves; of two linked ones, one half differs
in at most 2 bits. In each half the anchors are the codewords of the perfect Hamming
code on 31 bits (the 32nd bit of a half is free): every word has an anchor within
covering radius 1. The midpoint of two halves at distance 2 is 1 from both, and has
an anchor within 1, so replicating each fingerprint to every anchor within covering
radius 1 plus half the half's threshold, 1, brings every linked pair together at some
anchor: 16 anchors a half (1 for a codeword) instead of the thousands that radius
plus threshold over 64 bits would take. Candidates are compared per anchor.

Equal fingerprints are one row before the search, so groups of exact copies cost
nothing. In a large anchor bucket a breadth-first search emits a spanning forest
of its links, not all pairs. Components come from these links.

Null, empty and blank texts have fingerprint zero, linked like any other. Rows of
null doc_id take part; a component of null ids only has component_id null. Repeated
rows and ties keep their row each. Very long texts go whole; a task holds one Arrow batch's
hashes, of which those of one text are the least part. An empty table gives no rows. Only
doc_id and text are read; clashing names of other columns do no harm.

Scale. Fingerprints and roots that many rows share are joined by broadcast. 1e10 different
fingerprints spread evenly make about 2,400 a bucket (32 rows each over 2^27 anchors), a
search of at most 3e6 comparisons a bucket and 4e14 in all: about 100 core hours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, columns, free, spread_join
from .components import connected

DISTANCE, SHINGLE, SEED = 4, 4, 42
SMALL = 64  #: buckets up to this size are compared by shifting the sorted rows


def shingle_hashes(words: list[bytes]) -> list[int]:
    from xxhash import xxh64_intdigest as h

    if len(words) < SHINGLE:
        return [h(b" ".join(words), SEED)] if words else []
    text = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return [h(text[a:b], SEED) for a, b in zip((ends - sizes)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """As unsigned 64-bit numbers."""
    out, held, counts, at = np.zeros(len(texts), np.uint64), [], [], 0

    def flush(to: int) -> None:
        nonlocal at
        n = np.array(counts, np.int64)
        if held:
            h = np.array(held, "<u8")
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            some = np.flatnonzero(n)
            ones = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int64)
            out[at + some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
        held.clear()
        counts.clear()
        at = to

    for i, t in enumerate(texts):
        found = shingle_hashes(t.lower().split()) if t else []
        held += found
        counts.append(len(found))
        if len(held) > 100_000:
            flush(i + 1)
    flush(len(texts))
    return out


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text) and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fingerprints(texts).view(np.int64))], names=["doc_id", "th", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, th long, fp long")


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which fingerprint, and the codeword, for all codewords within 2 of each 31-bit half."""
    half = half & np.uint64(0x7FFFFFFF)
    at = np.arange(1, 32, dtype=np.uint64)
    syndrome = np.zeros(len(half), np.uint64)
    for i in at:
        syndrome ^= ((half >> (i - np.uint64(1))) & np.uint64(1)) * i
    flips = np.zeros((32, 16), np.uint64)  # by syndrome: the errors of weight 1 and 2 that have it
    for s in range(1, 32):
        flips[s] = [1 << (s - 1), *((1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s and i != s)]
    none = np.flatnonzero(syndrome == 0)
    some = np.flatnonzero(syndrome)
    near = half[some, None] ^ flips[syndrome[some].astype(np.int64)]
    return np.concatenate([none, np.repeat(some, 16)]), np.concatenate([half[none], near.ravel()])


def replicate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """anchor, fingerprint: a row for each anchor of either half."""
    out = []
    for k in (0, 1):
        who, code = anchors(x >> np.uint64(32 * k))
        out.append((code | np.uint64(k << 32), x[who]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def links(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: links that connect what DISTANCE connects within each key."""
    a, b = [], []
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[starts, len(key)])
    keep = np.repeat((size > 1) & (size <= SMALL), size)
    k, v = key[keep], x[keep]
    for d in range(1, min(SMALL, len(k))):
        i = np.flatnonzero(k[d:] == k[:-d])
        if not len(i):
            break
        i = i[np.bitwise_count(v[i] ^ v[i + d]) <= DISTANCE]
        a.append(v[i])
        b.append(v[i + d])
    for s, n in zip(starts[size > SMALL], size[size > SMALL], strict=True):
        rest, front = np.unique(x[s : s + n]), []
        while len(rest):
            p = front.pop() if front else rest[0]
            near = np.bitwise_count(rest ^ p) <= DISTANCE
            new = rest[near & (rest != p)]
            a.append(np.full(len(new), p))
            b.append(new)
            front.extend(new)
            rest = rest[~near & (rest != p)]
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def link_table(prints: DataFrame) -> DataFrame:
    """Links a, b among distinct fingerprints (column fp)."""

    def spread(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(x), 4096):
                key, v = replicate(x[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(v.view(np.int64))], names=["anchor", "fp"])

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(key: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in links(key, x)], names=["a", "b"])

        key = x = np.empty(0, np.uint64)
        for batch in batches:
            k, v = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            key, x = np.concatenate([key, k]), np.concatenate([x, v])
            if len(key) and key[0] != key[-1]:
                cut = int(np.searchsorted(key.view(np.int64), key.view(np.int64)[-1]))
                yield out(key[:cut], x[:cut])
                key, x = key[cut:], x[cut:]
        if len(key):
            yield out(key, x)

    rows = prints.select("fp").mapInArrow(spread, "anchor long, fp long")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, th, fp, root (the same for all documents of a component) and component_id."""
    every = checkpointed(with_fingerprint(docs))
    total = every.count()
    reps = every.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    roots = connected(link_table(reps))
    linked = checkpointed(roots.withColumnRenamed("node", "fp").join(reps.select("fp", "first_id"), "fp"))
    classes = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    named = spread_join(linked.select("root", "fp"), classes, "root", total)
    all_prints = reps.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"), "n")
    return spread_join(every, checkpointed(all_prints), "fp", total)


def digest(docs: DataFrame) -> DataFrame:
    """op4: doc_id, fingerprint, component_id."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the row of the least doc_id of each component stays (nulls last; then by hash of the text), once."""
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    key = free(docs, "_key")
    stay = near_groups(docs).groupBy("root").agg(F.min(least).alias("k")).select(F.struct("k.doc_id", "k.th").alias(key))
    # one key column for both steps (nulls in it are equal), so the texts are shuffled once
    keyed = docs.withColumn(key, F.struct(F.col("doc_id"), F.xxhash64("text").alias("th")))
    return keyed.join(stay, key, "left_semi").dropDuplicates([key]).select(*columns(docs))
