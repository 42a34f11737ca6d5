"""Language-model scoring by a weighted backoff automaton.

Training counts words, pairs and triples over all training documents. The automaton's
states are the histories seen: two words, one word, or none. The state after a token is
the longest of them that the text ends in. From history h, every word w seen after it has
an arc of weight c(hw) / (c(h) + MU), and the failure arc to the next shorter history has
weight MU / (c(h) + MU): a Dirichlet-smoothed model, in which what an arc and the failure
path give is added, so the probabilities after a history sum to 1 over the known words and
one unknown. Without a history each word has its add-one probability. A text is traversed
once, left to right, from the end state, a history of one word, to the end token.

No machine holds the whole automaton. Documents are dealt into chunks of about HELD tokens.
A chunk sends its distinct words, pairs and triples, with their counts in its training
documents, to hash ranges; the ranges add the counts up and answer each chunk in the order it
asked. With these numbers a chunk has the states and arcs that its own texts can reach,
weighted by the whole corpus, and traverses them with numpy, all tokens at once: the state
before a token follows from the two tokens before it. One way at every size; the number of
ranges grows with the bytes of text, so that a range stays small, and a frequent word is one
number a chunk. Words, pairs and triples go by 64-bit hashes.

Null and empty texts are the end token alone. Without training rows every word is unknown:
N = V = 0. A null doc_id is in training. Repeated rows count each. A very long text lies
in one chunk whole. An empty table gives no rows. Only doc_id and text are read; other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, partitions, stored
from .wordhash import Hasher, Slice, mix, slices

#: Weight of the failure arcs from histories of one and of two words; tokens of a chunk.
MU, HELD = (300.0, 20.0), 2_000_000
#: Bytes of text for one hash range, and the least and most ranges (powers of two).
RANGE_BYTES, RANGES = 8_000_000, (16, 1 << 24)
#: Bytes of text for one task over chunks.
TASK_BYTES = 16_000_000
_U = np.uint64
END = _U(0x5851F42D4C957F2D)
_FACTOR = _U(0x9E3779B97F4A7C15)


def tokens(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes with an end after each document's words, and where each document starts."""
    docs = len(s.first) - 1
    doc = np.repeat(np.arange(docs), np.diff(s.first))
    out = np.full(len(s.hashes) + docs, END)
    out[np.arange(len(doc)) + doc] = s.hashes
    return out, s.first[:-1] + np.arange(docs)


def grams(t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token its word's, pair's and triple's hash. A text's first token has the end before it, and no triple: its pair's hash again."""
    before = np.r_[END, t[:-1]]
    before[first] = END
    with np.errstate(over="ignore"):
        two = mix(before * _FACTOR + t)
        three = mix(np.r_[two[:1], two[:-1]] * _FACTOR + (t ^ _FACTOR))
    three[first] = two[first]
    return t, two, three


def tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their total counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first)


def _zstd():
    import zstandard as z

    return z.ZstdCompressor(level=1), z.ZstdDecompressor()


def packed(counts: np.ndarray) -> bytes:
    """Each in as few bytes (1, 2, 4 or 8) as the greatest needs, compressed."""
    top = int(counts.max()) if len(counts) else 0
    return _zstd()[0].compress(counts.astype(next(f"<u{b}" for b in (1, 2, 4, 8) if top < 1 << 8 * b)).tobytes())


def unpacked(data: bytes, n: int) -> np.ndarray:
    data = _zstd()[1].decompress(data)
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def squeezed(keys: np.ndarray) -> bytes:
    """Sorted keys by the differences of neighbours, byte by byte: the high bytes compress."""
    planes = np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T
    parts = [(c if len(c) < len(p) else p) for p, c in ((p.tobytes(), _zstd()[0].compress(p.tobytes())) for p in planes)]
    return np.array([len(keys), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def unsqueezed(data: bytes) -> np.ndarray:
    n, *sizes = np.frombuffer(data[:36], "<u4").tolist()
    planes, at = np.empty((8, n), np.uint8), 36
    for i, size in enumerate(sizes):
        part = data[at : at + size]
        planes[i] = np.frombuffer(part if size == n else _zstd()[1].decompress(part), np.uint8)
        at += size
    return np.cumsum(np.ascontiguousarray(planes.T).view(_U).ravel(), dtype=_U)


def ranges_for(text_bytes: int) -> int:
    least, most = RANGES
    return min(most, max(least, 1 << (text_bytes // RANGE_BYTES).bit_length()))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def pieces(keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """Sorted keys by hash range: the range, and where it begins and ends."""
    bounds = np.arange(1, ranges, dtype=_U) << _U(64 - ranges.bit_length() + 1)
    at = np.r_[0, np.searchsorted(keys, bounds), len(keys)]
    return [(int(i), int(at[i]), int(at[i + 1])) for i in np.flatnonzero(np.diff(at))]


class Merger:
    """The sums of one range. New arrays wait until they outweigh the sums, so an element is merged few times."""

    def __init__(self):
        self.sums, self.waiting, self.n = (np.empty(0, _U), np.empty(0, np.int64)), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n += len(keys)
        if self.n > max(HELD, len(self.sums[0])):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        self.sums = tally(*(np.concatenate(x) for x in zip(self.sums, *self.waiting, strict=True)))
        self.waiting, self.n = [], 0
        return self.sums


#: kind: 0 words, 1 pairs, 2 triples; 3: a range's training tokens and distinct words.
ASKED = "kind int, part int, chunk long, keys binary, counts binary, total long, distinct long"
SCORED = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _batch(rows: list[tuple]):
    import pyarrow as pa

    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in ASKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in rows], types[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def planes(places: np.ndarray) -> bytes:
    """4-byte numbers, all lowest bytes first, so that the empty high bytes compress."""
    return places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def placed(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def chunked(docs: DataFrame) -> DataFrame:
    """docs (doc_id, held_out, text) as a row for each chunk: doc_ids, held_out, numbers of tokens, distinct words and the tokens' places among them."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        hasher, chunk, held, size = Hasher(lower=True), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for s in slices(batch.column(2), hasher):
                t, first = tokens(s)
                held.append((batch.column(0)[s.rows], batch.column(1)[s.rows], np.diff(np.r_[first, len(t)]), t))
                size += len(t)
                if size > HELD:
                    yield send(chunk, held)
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield send(chunk, held)

    def send(chunk: int, held: list[tuple]):
        import pyarrow as pa

        ids, out, n, t = zip(*held, strict=True)
        words, at = np.unique(np.concatenate(t), return_inverse=True)
        lists = [pa.concat_arrays(ids), pa.concat_arrays(out), pa.array(np.concatenate(n), pa.int64())]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *lists, pa.array([squeezed(words)]), pa.array([planes(at)])], names=["chunk", "ids", "held", "n", "words", "at"])

    return docs.mapInArrow(scan, f"chunk long, ids array<{kind}>, held array<boolean>, n array<long>, words binary, at binary")


def asked(chunks: DataFrame, ranges: int) -> DataFrame:
    """ASKED rows: each chunk's distinct words, pairs and triples by range, with their counts in its training documents."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for chunk, held, n, words, at in zip(*batch.columns, strict=True):
                n = n.values.to_numpy()
                trains = np.repeat(~held.values.to_numpy(zero_copy_only=False).astype(bool), n)
                t = unsqueezed(words.as_py())[placed(at.as_py())]
                for kind, g in enumerate(grams(t, np.r_[0, np.cumsum(n)[:-1]])):
                    keys, place = np.unique(g, return_inverse=True)
                    counts = np.bincount(place[trains], minlength=len(keys))
                    yield _batch([(kind, i, chunk.as_py(), squeezed(keys[a:b]), packed(counts[a:b])) for i, a, b in pieces(keys, ranges)])

    return chunks.select("chunk", "held", "n", "words", "at").mapInArrow(run, ASKED)


def answered(asks: DataFrame) -> DataFrame:
    """ASKED rows, each range's together and sorted by kind -> the same rows without keys, with the counts of all chunks; and rows of kind 3."""

    def run(batches: Iterator) -> Iterator:
        now, rows = None, []
        for batch in batches:
            for kind, part, chunk, keys, counts in zip(*batch.columns[:5], strict=True):
                here = part.as_py(), kind.as_py()
                if here != now:
                    yield from answer(now, rows)
                    now, rows = here, []
                rows.append((chunk.as_py(), unsqueezed(keys.as_py()), counts.as_py()))
        yield from answer(now, rows)

    def answer(now: tuple | None, rows: list[tuple]) -> Iterator:
        if not rows:
            return
        part, kind = now
        merger = Merger()
        for _, keys, counts in rows:
            merger.add(keys, unpacked(counts, len(keys)))
        keys, counts = merger.total()
        for chunk, wanted, _ in rows:
            yield _batch([(kind, part, chunk, b"", packed(counts[np.searchsorted(keys, wanted)]))])
        if kind == 0:
            yield _batch([(3, part, None, b"", b"", int(counts.sum()), int((counts > 0).sum()))])

    return asks.mapInArrow(run, ASKED)


def traversed(counts: tuple[np.ndarray, np.ndarray, np.ndarray], end: int, first: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token, by the training counts of its word, pair and triple and of the end: its add-one probability, and its probability in the state before it.

    The state before a token is the pair before it where that was seen, else the word, else
    none: a history not seen has failure weight 1 and no arcs. A text starts after the end.
    """
    one, two, three = counts
    alone = (one + 1.0) / (total + distinct + 1)
    word, pair = np.r_[end, one[:-1]], np.r_[0, two[:-1]]
    word[first] = end
    p = (two + MU[0] * alone) / (word + MU[0])
    longer = (three + MU[1] * p) / (pair + MU[1])
    longer[first] = p[first]
    return alone, longer


def scored(docs: DataFrame) -> DataFrame:
    """docs: doc_id, held_out, text. A row for each: doc_id, held_out and SCORED, by a model of those not held out."""
    spark, size = docs.sparkSession, text_bytes(docs)
    ranges = ranges_for(size)
    tasks = min(max(partitions(spark), size // TASK_BYTES), 100_000)
    chunks = bucketed(chunked(docs), "chunk", tasks)
    dealt = asked(chunks, ranges).repartition(max(partitions(spark), ranges), "part").sortWithinPartitions("part", "kind", "chunk")
    answers = stored(answered(dealt))
    total, distinct = (x or 0 for x in answers.filter("kind = 3").agg(F.sum("total"), F.sum("distinct")).first())
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def score(chunk, answers):
        import pyarrow as pa

        (chunk,) = chunk.combine_chunks().to_batches()
        ids, held, n, words, at = chunk.columns[1:]
        n = n.values.to_numpy()
        first = np.r_[0, np.cumsum(n)[:-1]]
        t = unsqueezed(words[0].as_py())[placed(at[0].as_py())]
        by: dict[tuple, bytes] = {(k, i): c for k, i, c in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "counts")), strict=True)}
        counts, end = [], 0
        for kind, g in enumerate(grams(t, first)):
            keys, place = np.unique(g, return_inverse=True)
            found = np.concatenate([unpacked(by[kind, i], b - a) for i, a, b in pieces(keys, ranges)])
            counts.append(found[place])
            if kind == 0:
                end = int(found[np.searchsorted(keys, END)])
        alone, p = traversed(tuple(counts), end, first, total, distinct)
        sums = [np.add.reduceat(x, first) for x in ((counts[0] > 0).astype(np.int64), np.log10(alone), np.log10(p))]
        return pa.table([ids.values, held.values, pa.array(n), pa.array(sums[0]), pa.array(np.full(len(n), total)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "held_out", *(x.split()[0] for x in SCORED.split(", "))])

    theirs = answers.filter("kind < 3").select("kind", "part", "chunk", "counts").repartition(tasks, "chunk").groupBy("chunk")
    return chunks.groupBy("chunk").cogroup(theirs).applyInArrow(score, f"doc_id {id_type}, held_out boolean, {SCORED}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """op10."""
    return scored(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"))
