"""Substring deduplication with suffix automata.

A window of 20 words is removed where its word sequence starts earlier too. Broadcasting
the automata of all corpus shards to all documents would cost shards times documents, so
reference and documents meet by anchors instead: the least hash of the 6-word groups of a
window is its anchor, consecutive windows with one anchor are a run, and equal windows
have equal anchors, wherever they stand. Runs are dealt out by anchor.

1. Runs whose whole word sequence is that of an earlier run are decided at once. This
   is done in each slice of the scan first, so a passage that a third of the documents
   share sends one row a slice, then among all runs of an anchor.
2. Where an anchor has several different runs (the ends of passages, edits), the first
   run of each sequence is a reference passage: a suffix automaton of the earlier ones
   is built word by word, each passage is streamed through it for matching statistics,
   and ends of matches of 20 or more words give the windows to remove.
   Where over CROWDED passages meet (a shared passage after many different words), they
   are cut into window hashes instead: the first place of each by a pre-aggregated
   grouping, joined back, so that no anchor is one task's work.
3. Documents join their removed windows, and the words these cover go.

reference_spans() is the broadcast form for a reference of bounded size.

Words are compared by 64-bit hashes. Null, empty and short texts lose nothing; very long
ones are scanned whole. Rows are known by doc_id and a hash of the text; of rows with one
doc_id none is earlier at the same start, so repeated rows keep what one of them keeps. A
null doc_id counts as less than any other; doc_ids that are not integers are ordered as
their type orders them. An empty table gives no rows. Only doc_id and text are read; other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ordered_ids, stored
from .wordhash import Hasher, Slice, mix, slices

WINDOW, GROUP = 20, 6
#: Passages of one anchor that an automaton takes, and places of one window beyond which its first place is broadcast.
CROWDED, HOT = 64, 10_000
_U = np.uint64


class Automaton:
    """A suffix automaton of several sequences, grown one item at a time."""

    def __init__(self) -> None:
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, length: int, link: int, arcs: dict) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def add(self, sequence: Iterable[int]) -> None:
        last = 0
        for c in sequence:
            if (q := self.next[last].get(c)) is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = new

    def statistics(self, sequence: Iterable[int]) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        at = size = 0
        out = []
        for c in sequence:
            while at and c not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            if (q := self.next[at].get(c)) is not None:
                at, size = q, size + 1
            out.append(size)
        return out


def runs(s: Slice, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """Of a slice's documents: each run's document, first window (in the document), number of windows, anchor and context hash."""
    h, n = s.hashes, len(s.hashes)
    if n < WINDOW:
        e = np.empty(0, np.int64)
        return e, e, e, e.astype(_U), e.astype(_U)
    with np.errstate(over="ignore"):
        m = n - GROUP + 1
        g = mix(sum((h[i : m + i] * _U(2 * i + 3) + (h[i : m + i] >> _U(7 + i))) for i in range(GROUP)))
        value, place, reach = g, np.arange(m), 1
        width = WINDOW - GROUP + 1
        while reach < width:  # least of reach values, the first on ties
            step = min(reach, width - reach)
            less = value[step:] < value[:-step]
            value, place = np.where(less, value[step:], value[:-step]), np.where(less, place[step:], place[:-step])
            reach += step
        doc = np.repeat(np.arange(len(s.first) - 1), np.diff(s.first))
        starts = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
        if not len(starts):
            e = np.empty(0, np.int64)
            return e, e, e, e.astype(_U), e.astype(_U)
        p = place[starts]
        begin = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc[starts[1:]] != doc[starts[:-1]])])
        first, count = starts[begin], np.diff(np.r_[begin, len(starts)])
        hasher._powers(n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum(h * hasher.power[:n], out=sums[1:], dtype=_U)
        end = first + count + WINDOW - 1
        context = mix((sums[end] - sums[first]) * hasher.inverse[first] + (count * 64 + p[begin] - first).astype(_U) * _U(0xD6E8FEB86659FD93))
    d = doc[first]
    return d, first - s.first[d], count, g[p[begin]], context


RUN = "anchor long, context long, doc_id long, th long, start long, n long"


def scan(docs: DataFrame) -> DataFrame:
    """Runs (RUN) of documents; context is null for runs decided in their slice: all their windows start earlier elsewhere."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hasher = Hasher()
        for batch in batches:
            ids, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for s in slices(batch.column(2), hasher):
                d, start, n, anchor, context = runs(s, hasher)
                doc, t = ids[s.rows][d], th[s.rows][d]
                order = np.lexsort((start, doc, context, anchor))
                d, start, n, anchor, context, doc, t = (x[order] for x in (d, start, n, anchor, context, doc, t))
                new = np.r_[True, (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])] if len(d) else np.empty(0, bool)
                least = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0)) if len(d) else np.empty(0, np.int64)
                earlier = (doc[least] != doc) | (start[least] != start)
                with np.errstate(over="ignore"):  # what is decided need not meet its anchor
                    anchor = np.where(earlier, mix(anchor + doc.view(_U) * _U(31) + start.astype(_U)), anchor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64), mask=earlier), pa.array(doc), pa.array(t), pa.array(start), pa.array(n)],
                    names=[c.split()[0] for c in RUN.split(", ")],
                )

    return docs.select("doc_id", "th", "text").mapInArrow(run, RUN)


def decide(dealt: DataFrame) -> DataFrame:
    """Runs, each anchor's together and sorted. Returns runs to remove whole (context null) and reference passages (context kept)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in RUN.split(", ")]

        def out(rows: np.ndarray, keep: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[i], mask=None if keep or i != 1 else np.ones(rows.shape[1], bool)) for i in range(6)], names=names)

        held = np.empty((6, 0), np.int64)
        for batch in _ended(batches):
            if batch is None:
                rows, last = held, None
            else:
                gone = batch.column(1).is_null().to_numpy(zero_copy_only=False)
                rows = np.stack([batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(6)])
                if gone.any():
                    yield out(rows[:, gone], False)
                rows = np.concatenate([held, rows[:, ~gone]], axis=1)
                last = rows[0, -1] if rows.shape[1] else None
            if not rows.shape[1]:
                held = rows
                continue
            anchor, context, doc, _, start, _ = rows
            fresh = np.r_[True, anchor[1:] != anchor[:-1]]
            new = fresh | np.r_[True, context[1:] != context[:-1]]
            least = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            earlier = (doc[least] != doc) | (start[least] != start)
            if earlier.any():
                yield out(rows[:, earlier], False)
            group = np.cumsum(fresh) - 1
            several = np.bincount(group, weights=new)[group] > 1
            stay = ~earlier & (np.full(len(new), True) if last is None else anchor != last)
            yield out(rows[:, stay & several], True)
            held = rows[:, ~earlier & ~stay]

    return dealt.mapInArrow(run, RUN)


def _ended(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def windows(h: np.ndarray, at: np.ndarray, hasher: Hasher) -> np.ndarray:
    """Hashes of the windows of h that start there."""
    hasher._powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(h * hasher.power[: len(h)], out=sums[1:], dtype=_U)
        return mix((sums[at + WINDOW] - sums[at]) * hasher.inverse[at])


def repeated(found: DataFrame) -> DataFrame:
    """Windows (anchor: their hash) of crowded anchors: doc_id, th, start, n of those that start earlier too."""
    place = F.struct("doc_id", "start")
    first = found.groupBy("anchor").agg(F.min(place).alias("first"), F.count("*").alias("places")).filter("places > 1")
    hot = F.broadcast(first.filter(F.col("places") > HOT).select("anchor", F.col("first").alias("hot")))
    rest = first.filter(F.col("places") <= HOT).select("anchor", "first")
    rows = found.select("anchor", "doc_id", "th", "start").join(hot, "anchor", "left")
    both = rows.filter("hot is not null").withColumnRenamed("hot", "first").unionByName(rows.filter("hot is null").drop("hot").join(rest, "anchor"))
    return both.filter(F.col("first") < place).select("doc_id", "th", "start", F.lit(1).cast("long").alias("n"))


def passages(asked: DataFrame) -> DataFrame:
    """asked: th, doc_id, text and asked (array of anchor, start, n, crowded). The reference passages' word hashes; of crowded ones each window's hash, as anchor, without words."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hasher = Hasher()
        for batch in batches:
            wanted = batch.column(3)
            for s in slices(batch.column(2), hasher):
                part = wanted[s.rows]
                flat = part.flatten()
                anchor, start, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                d = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
                a, crowded = s.first[d] + start, flat.field(3).to_numpy(zero_copy_only=False).astype(bool)
                h = s.hashes.view(np.int64)
                words = pa.array([h[i : i + k + WINDOW - 1] for i, k in zip(a[~crowded], n[~crowded], strict=True)], pa.list_(pa.int64()))
                yield batch_of(batch, anchor[~crowded], d[~crowded] + s.rows.start, start[~crowded], words)
                if crowded.any():
                    k = n[crowded]
                    step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    yield batch_of(batch, windows(s.hashes, np.repeat(a[crowded], k) + step, hasher).view(np.int64), np.repeat(d[crowded], k) + s.rows.start, np.repeat(start[crowded], k) + step, pa.nulls(len(step), pa.list_(pa.int64())))

    def batch_of(batch, anchor: np.ndarray, take: np.ndarray, start: np.ndarray, words):
        import pyarrow as pa

        take = pa.array(take)
        return pa.RecordBatch.from_arrays([pa.array(anchor), batch.column(0).take(take), batch.column(1).take(take), pa.array(start), words], names=["anchor", "doc_id", "th", "start", "words"])

    return asked.mapInArrow(run, "anchor long, doc_id long, th long, start long, words array<long>")


def resolve(found: DataFrame) -> DataFrame:
    """Passages, each anchor's together, sorted by doc_id and start: doc_id, th, start, n of windows that start earlier too."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, automaton, key, waiting = None, Automaton(), None, []
        for batch in batches:
            out = []
            for anchor, doc, th, start, words in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if anchor != at:
                    at, automaton, key, waiting = anchor, Automaton(), None, []
                if (doc, start) != key:  # only then are the passages before this one earlier
                    for w in waiting:
                        automaton.add(w)
                    key, waiting = (doc, start), []
                begin = None
                for i, size in enumerate([*automaton.statistics(words), 0] if len(automaton.next) > 1 else ()):
                    if size >= WINDOW:
                        begin = i if begin is None else begin
                    elif begin is not None:
                        out.append((doc, th, start + begin - WINDOW + 1, i - begin))
                        begin = None
                waiting.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4, names=["doc_id", "th", "start", "n"])

    return found.mapInArrow(run, "doc_id long, th long, start long, n long")


def without(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs: doc_id, text, gone (array of start, n windows, or null). Words in a window that goes are removed: n_words, n_removed, kept_text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, gone = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)
            total, removed, kept = [], [], []
            for i, t in enumerate(texts):
                words = t.split() if t else []
                total.append(len(words))
                if gone[i].is_valid and words:
                    flat = gone[i].values
                    a, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, a, 1)
                    np.add.at(step, a + n + size - 1, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "gone").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for each document row."""
    docs = docs.select("doc_id", "text")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        docs = docs.withColumn("id", F.col("doc_id").cast("long"))
    else:  # numbered in their own order
        docs = docs.join(ordered_ids(docs, "doc_id").withColumnRenamed("n", "id"), "doc_id", "left")
    docs = docs.withColumn("id", F.coalesce("id", F.lit(-(2**63)))).withColumn("th", F.xxhash64("text"))
    keyed = docs.select(F.col("id").alias("doc_id"), "th", "text")
    dealt = scan(keyed).repartition("anchor").sortWithinPartitions("anchor", "context", "doc_id", "start")
    decided = stored(decide(dealt))
    several = decided.filter("context is not null").select("anchor", "doc_id", "th", "start", "n")
    crowded = several.groupBy("anchor").count().filter(F.col("count") > CROWDED).select("anchor", F.lit(True).alias("crowded"))
    several = several.join(crowded, "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    asked = several.groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "start", "n", "crowded")).alias("asked"))
    texts = keyed.join(asked, ["doc_id", "th"]).select("doc_id", "th", "text", "asked")
    found = stored(passages(texts))
    partly = resolve(found.filter("words is not null").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start"))
    partly = partly.union(repeated(found.filter("words is null")))
    gone = decided.filter("context is null").select("doc_id", "th", "start", "n").union(partly)
    gone = gone.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n")).alias("gone")).withColumnRenamed("doc_id", "id")
    return without(docs.join(gone, ["id", "th"], "left"))


def reference_spans(docs: DataFrame, reference: DataFrame, size: int = WINDOW, shard_words: int = 200_000, max_words: int = 2_000_000) -> DataFrame:
    """The broadcast form: words of docs within matches of size or more words with texts of a bounded reference go.

    The reference (column text) is cut into shards of shard_words, an automaton each; over max_words it is refused.
    """
    hasher = Hasher()
    held: list[list[list[int]]] = [[]]
    total = here = 0
    for row in reference.select("text").toLocalIterator():
        words = hasher.words(np.frombuffer((row.text or "").encode(), np.uint8), np.array([0, len((row.text or "").encode())]))[2].tolist()
        total, here = total + len(words), here + len(words)
        if total > max_words:
            raise ValueError(f"the reference has over {max_words} words; use deduplicated()")
        if here > shard_words:
            held.append([])
            here = len(words)
        held[-1].append(words)
    shards = []
    for texts in held:
        shards.append(Automaton())
        for words in texts:
            shards[-1].add(words)
    shipped = docs.sparkSession.sparkContext.broadcast([vars(x) for x in shards])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, automata = Hasher(), [object.__new__(Automaton) for _ in shipped.value]
        for x, content in zip(automata, shipped.value, strict=True):
            vars(x).update(content)
        for batch in batches:
            for s in slices(batch.column(1), own):
                gone = []
                for a, b in zip(s.first[:-1], s.first[1:], strict=True):
                    words = s.hashes[a:b].tolist()
                    best = np.max([x.statistics(words) for x in automata], axis=0) if words else np.empty(0)
                    gone.append([{"start": int(e) - size + 1, "n": 1} for e in np.flatnonzero(best >= size)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[s.rows], batch.column(1)[s.rows], pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())])))], names=["doc_id", "text", "gone"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return without(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, gone array<struct<start:long,n:long>>"), size)


def digest(docs: DataFrame) -> DataFrame:
    """op6."""
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
