"""Packing by lexical retrieval: BM25 neighbours fill the windows of seed documents.

1. Documents are tokenised once (byte-level BPE, then an end id), and whole windows of
   SIZE ids are cut off; what is left over, under SIZE ids each, is the pool. The scan
   also counts in how many documents each id occurs; that table has one row an id of
   the vocabulary at most.
2. The pool is range-partitioned by a lexical sketch (a min-hash of its ids), so that
   texts with rare ids in common tend to meet, ties broken by doc_id, so that no sketch
   overloads a shard. A shard holds about SHARD ids.
3. In a shard an inverted index gives, for each seed (the first unused text), BM25
   scores of unused texts by all of the seed's ids, with the document counts of the
   whole corpus. The best that fit are taken whole, while any does; then the best one
   left, or the next in order, is cut to fill the window, and its rest stays unused.
   The last window of a shard is cut into powers of two. So there is no padding.

Null and empty texts are one end id. Very long texts are encoded whole; only their rest
below a window waits in a shard. Repeated rows are packed each, and a null doc_id sorts
first. An empty table gives no pieces. Only doc_id and text are read; other columns may have
any name.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .wordhash import Hasher, mix, slices

SIZE, END, SHARD = 2048, 1, 2_000_000
K1, B = 1.2, 0.75
VOCABULARY = 50257
_SHIFT = np.uint64(44)


class Encoder:
    """The ids of byte_bpe_50k, by its ranks; words between single spaces are remembered by 64-bit hashes.

    A token never spans from a word into a following space, so a text may be cut before
    any space that has no white space on its left and right; other texts go whole.
    """

    def __init__(self, vocabulary: str | None = None, keep: int = 1_000_000, added: dict[str, int] | None = None):
        """added: tokens matched in the text before BPE, and their ids; without, they are plain text."""
        import public_tokenizers as P
        import tiktoken

        with open(vocabulary or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ids = tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)  # of each id
        for word, i in ranks.items():
            self.bytes[i] = len(word)
        self.added = added or {}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.whole = re.compile(r"\s (?:\s|\Z)")
        self.keep, self.hasher = keep, Hasher(b" ")
        self._forget()
        # bytes that may end a white-space character, and that may begin one
        self.left, self.right = np.zeros(256, bool), np.zeros(256, bool)
        for x in (self.left, self.right):
            x[[*range(9, 14), *range(28, 33)]] = True
        self.left[128:] = True
        self.right[[0xC2, 0xE1, 0xE2, 0xE3]] = True

    def _forget(self) -> None:
        self.words, self.begin, self.size, self.pool, self.used = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(1 << 16, "<u2"), 0
        self.start = np.zeros((1 << 20) + 1, np.int64)

    def encode(self, text: str | None) -> np.ndarray:
        """One text, without the memory."""
        if not text:
            return np.empty(0, "<u2")
        if self.cuts and self.cuts.search(text):
            parts = self.cuts.split(text)  # texts and added tokens by turns
            return np.concatenate([np.array([self.added[p]] if i % 2 else self.ids(p), "<u2") for i, p in enumerate(parts)])
        return np.array(self.ids(text), "<u2")

    def _odd(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Documents that can't be cut at spaces (or so it seems from their bytes), or hold added tokens."""
        odd = np.zeros(len(cuts), bool)
        space = np.flatnonzero(data == 32)
        edge = np.zeros(len(data) + 1, bool)
        edge[cuts] = True
        before = edge[space] | self.left[data[space - 1]]
        after = edge[space + 1] | self.right[data[np.minimum(space + 1, len(data) - 1)]]
        beside = edge[space] | (data[space - 1] == 32) | edge[space + 1]
        bad = space[(before & after) | beside]
        odd[np.searchsorted(cuts, bad, "right") - 1] = True
        raw = data.tobytes() if self.added else b""
        for token in self.added:
            at = raw.find(token.encode())
            while at >= 0:
                odd[np.searchsorted(cuts, at, "right") - 1] = True
                at = raw.find(token.encode(), at + 1)
        return odd[:-1]

    def _look(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is among the known words, and whether; by the hash's high bits, then one by one."""
        at, end = (self.start[(key >> _SHIFT) + i] for i in (np.uint64(0), np.uint64(1)))
        has = np.zeros(len(key), bool)
        rest = np.flatnonzero(at < end)
        while len(rest):
            same = self.words[at[rest]] == key[rest]
            has[rest[same]] = True
            rest = rest[~same]
            at[rest] += 1
            rest = rest[at[rest] < end[rest]]
        return at, has

    def _learn(self, keys: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray, opens: np.ndarray) -> None:
        """keys: sorted, none of them known; where their words are in data, and whether they open a text, without a space before them."""
        last = data[b - 1]
        # words that may begin or end in white space go one by one, the others at once: each ends where the next one's space begins
        alone = opens | self.right[data[a]] | ((last < 128) & self.left[last]) | ((last >= 128) & np.isin(data[np.maximum(b - 2, 0)], (0xC2, 0x80, 0x81, 0x9A)))
        many, one = np.flatnonzero(~alone), np.flatnonzero(alone)
        size = b[many] - a[many]
        ends = np.cumsum(size + 1)
        text = np.full(ends[-1] if len(ends) else 0, 32, np.uint8)
        text[np.repeat(ends - size, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = data[np.repeat(a[many], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        joined = np.array(self.ids(text.tobytes().decode()), "<u2")
        cuts = np.r_[0, np.searchsorted(np.cumsum(self.bytes[joined]), ends) + 1]
        found = [np.array(self.ids(("" if opens[i] else " ") + data[a[i] : b[i]].tobytes().decode()), "<u2") for i in one.tolist()]
        size = np.zeros(len(keys), np.int64)
        size[many], size[one] = np.diff(cuts), [len(x) for x in found]
        begin = np.zeros(len(keys), np.int64)
        begin[many], begin[one] = self.used + cuts[:-1], self.used + len(joined) + np.cumsum(size[one]) - size[one]
        more = np.concatenate([joined, *found])
        if self.used + len(more) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(len(self.pool), len(more)), "<u2")])
        self.pool[self.used : self.used + len(more)] = more
        self.used += len(more)
        at = np.searchsorted(self.words, keys)
        self.words, self.begin, self.size = np.insert(self.words, at, keys), np.insert(self.begin, at, begin), np.insert(self.size, at, size)
        self.start = np.r_[0, np.cumsum(np.bincount((self.words >> _SHIFT).astype(np.int64), minlength=1 << 20))]

    def encode_all(self, column) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow array, as of encode()."""
        for s in slices(column, self.hasher):
            n = len(s.first) - 1
            odd = self._odd(s.data, s.cuts) if len(s.data) else np.zeros(n, bool)
            doc = np.repeat(np.arange(n), np.diff(s.first))
            word = np.flatnonzero(~odd[doc])
            key = s.hashes[word]
            opens = s.starts[word] == s.cuts[doc[word]]  # no space before it
            key = np.where(opens, ~key, key)
            if len(self.words) > self.keep:
                self._forget()
            at, has = self._look(key)
            if not has.all():
                fresh, where = np.unique(key[~has], return_index=True)
                where = np.flatnonzero(~has)[where]
                self._learn(fresh, s.data, s.starts[word[where]], s.ends[word[where]], opens[where])
                at, has = self._look(key)
            size = self.size[at]
            total = np.cumsum(size)
            ids = self.pool[np.repeat(self.begin[at] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
            ends = np.r_[0, total][np.searchsorted(word, s.first[1:])]
            begins = np.r_[0, ends[:-1]]
            for i in range(n):
                yield self.encode(s.data[s.cuts[i] : s.cuts[i + 1]].tobytes().decode()) if odd[i] else ids[begins[i] : ends[i]]


def added_tokens() -> dict[str, int]:
    """The added tokens of the tokenizer's file."""
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def tokenised(docs: DataFrame) -> DataFrame:
    """Pieces that fill a window; pool texts (ids, sketch; sequence_id null); counts (term, n: its documents)."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, seen, count = Encoder(added=added_tokens()), np.zeros(VOCABULARY, bool), np.zeros(VOCABULARY, np.int64)
        order = mix(np.arange(1, VOCABULARY + 1, dtype=np.uint64)).view(np.int64)
        sequence = TaskContext.get().partitionId() << 33
        end = np.array([END], "<u2")
        types = {"sketch": pa.int64(), "ids": pa.binary(), "term": pa.int64(), "n": pa.int64()}
        names = [*PIECE, *types]

        def table(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], id_type if c == "doc_id" else types.get(c, pa.int64())) for c in names], names=names)

        rows, held = [], 0
        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1)), strict=True):
                ids = np.concatenate([found, end])
                seen[ids] = True
                terms = np.flatnonzero(seen)
                seen[terms] = False
                count[terms] += 1
                at = 0
                for at in range(0, len(ids) - SIZE + 1, SIZE):
                    rows.append({"doc_id": doc, "start": at, "length": SIZE, "ids_crc32": crc(ids[at : at + SIZE]), "doc_tokens": len(ids), "sequence_id": sequence, "offset": 0})
                    sequence += 2
                at = len(ids) - len(ids) % SIZE
                if at < len(ids):
                    rare = terms[terms > 1000]
                    rows.append({"doc_id": doc, "start": at, "length": len(ids) - at, "doc_tokens": len(ids), "sketch": int(order[rare].min()) if len(rare) else 0, "ids": ids[at:].tobytes()})
                held += len(ids)
                if held > 1 << 20:
                    yield table(rows)
                    rows, held = [], 0
        some = np.flatnonzero(count)
        yield table(rows + [{"term": int(t), "n": int(count[t])} for t in some])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in PIECE[1:]) + ", sketch long, ids binary, term long, n long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Shard:
    """Texts (arrays of ids) with an inverted index; fills windows."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray):
        self.texts, self.idf = texts, idf
        self.left = np.array([len(t) for t in texts], np.int64)  # ids not packed yet
        self.at = np.zeros(len(texts), np.int64)  # ids packed
        terms, tf = [], []
        for t in texts:
            s = np.sort(t, kind="stable")
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            terms.append(s[first])
            tf.append(np.diff(np.r_[first, len(s)]))
        self.terms = terms
        term = np.concatenate(terms)
        text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in terms])
        f = np.concatenate(tf).astype(np.float32)
        norm = (K1 * (1 - B + B * self.left / max(1.0, self.left.mean()))).astype(np.float32)
        by = np.argsort(term, kind="stable")
        self.text = text[by]
        self.weight = (idf[term] * f * (K1 + 1) / (f + norm[text]))[by]
        self.cuts = np.searchsorted(term[by], np.arange(VOCABULARY + 1))
        # lists of over a quarter of the texts are kept as rows of all texts
        many = np.flatnonzero(np.diff(self.cuts) > len(texts) / 4)
        self.row = np.full(VOCABULARY, -1)
        self.row[many] = np.arange(len(many))
        self.rows = np.zeros((len(many), len(texts)), np.float32)
        for k, t in enumerate(many.tolist()):
            at = slice(self.cuts[t], self.cuts[t + 1])
            self.rows[k, self.text[at]] = self.weight[at]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all texts by the seed's ids; 0 for those used up and the seed."""
        row = self.row[self.terms[seed]]
        at = [slice(self.cuts[t], self.cuts[t + 1]) for t in self.terms[seed][row < 0].tolist()]
        score = self.rows[row[row >= 0]].sum(axis=0, dtype=np.float64)
        if at:
            score += np.bincount(np.concatenate([self.text[a] for a in at]), np.concatenate([self.weight[a] for a in at]), len(self.texts))
        score[self.left == 0] = 0
        score[seed] = 0
        return score

    def take(self, i: int, room: int) -> tuple[int, int, int]:
        """Text, from, to: up to room of its unused ids."""
        n = min(room, int(self.left[i]))
        a = int(self.at[i])
        self.at[i] += n
        self.left[i] -= n
        return i, a, a + n

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        seed = 0
        while seed < len(self.texts):
            if not self.left[seed]:
                seed += 1
                continue
            window = [self.take(seed, SIZE)]
            room = SIZE - (window[0][2] - window[0][1])
            score = self.scores(seed) if room else None
            while room:
                fits = np.where(self.left <= room, score, 0)
                i = int(fits.argmax())
                if fits[i] <= 0:
                    break
                window.append(self.take(i, room))
                score[i] = 0
                room -= window[-1][2] - window[-1][1]
            following = seed + 1
            while room:
                i = int(score.argmax())
                if score[i] > 0:
                    score[i] = 0
                else:
                    while following < len(self.texts) and not self.left[following]:
                        following += 1
                    if following == len(self.texts):
                        break
                    i = following
                window.append(self.take(i, room))
                room -= window[-1][2] - window[-1][1]
            yield window

    def sequences(self) -> Iterator[list[tuple[int, int, int]]]:
        """Windows; one that is not full as sequences of powers of two."""
        for window in self.windows():
            total = sum(b - a for _, a, b in window)
            while total:
                room = size = 1 << (total.bit_length() - 1)
                out = []
                while room:
                    i, a, b = window.pop(0)
                    if b - a > room:
                        window.insert(0, (i, a + room, b))
                        b = a + room
                    out.append((i, a, b))
                    room -= b - a
                total -= size
                yield out


def packed(pool: DataFrame, idf: np.ndarray, shards: int) -> DataFrame:
    shipped = pool.sparkSession.sparkContext.broadcast(idf)
    id_field = pool.schema["doc_id"]
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(id_field.dataType)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        sequence = (TaskContext.get().partitionId() << 33) + 1
        held, size = [], 0

        def fill() -> pa.RecordBatch:
            nonlocal sequence
            shard, out = Shard([np.frombuffer(r[3], "<u2") for r in held], shipped.value), []
            for pieces in shard.sequences():
                offset = 0
                for i, a, b in pieces:
                    doc, start, tokens, _ = held[i]
                    out.append((doc, start + a, b - a, crc(shard.texts[i][a:b]), tokens, sequence, offset))
                    offset += b - a
                sequence += 2
            return pa.RecordBatch.from_arrays([pa.array(c, id_type if n == "doc_id" else pa.int64()) for c, n in zip(zip(*out, strict=True), PIECE, strict=True)], names=PIECE)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(row)
                size += len(row[3]) // 2
                if size >= 2 * SHARD:
                    yield fill()
                    held, size = [], 0
        if held:
            yield fill()

    key = ("sketch", "doc_id", "start", "ids")
    dealt = pool.repartitionByRange(shards, *key[:3]).sortWithinPartitions(*key)
    return dealt.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(run, f"doc_id {id_field.dataType.simpleString()}, " + ", ".join(f"{c} long" for c in PIECE[1:]))


def pack(docs: DataFrame) -> DataFrame:
    """op5: pieces, one row each."""
    every = stored(tokenised(docs))
    counts = np.zeros(VOCABULARY)
    for term, n in every.filter("term is not null").groupBy("term").agg(F.sum("n")).collect():
        counts[term] = n
    total = every.filter("ids is not null").agg(F.sum("length")).first()[0] or 0
    n = max(1.0, counts[END])  # every document has an end
    idf = np.log1p((n - counts + 0.5) / (counts + 0.5)).astype(np.float32)
    whole = every.filter("sequence_id is not null").select(*PIECE)
    return whole.unionByName(packed(every.filter("ids is not null"), idf, max(1, -(-total // SHARD))))
