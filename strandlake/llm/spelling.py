"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

Words are maximal runs of letters of whole texts, A-Z in lower case, of LEAST code points
and two occurrences at least. Two are near if one inserted, deleted or replaced code point
tells them apart. A word's form is its commonest near word if that is ten times as common;
its root is the last of its forms' forms.

Index. A word's bigrams with their positions are ordered by how rare the bigram is among
all words, then by position. One edit touches two bigrams at most, so of two near words
the first c bigrams that both share stand among the first c + 2 of either. Postings are
keyed by c such bigrams with positions and the length; of words of unequal length the
longer one is also posted a letter shorter, with the bigrams from some place on moved back
by one. So near words meet in some posting list, whatever their edit is.

Merge. A list's words are merged position by position into the number of bigrams that each
two share under the length and position limits; those with as many as one edit leaves,
the longer length less three, are verified letter by letter. Two words count only in the
list of their first c shared bigrams, so every pair counts once and no pair is ever a row:
a list returns a number and the best near word for each of its words.

Lists of over LIST postings aren't merged but give their words to the next c, which keys
by one bigram more, as long as words have bigrams for it (c up to length - 3, and LAST);
there a list holds words that share most bigrams, and is merged in blocks.

Null and blank texts have no words, null doc_ids are taken as empty ones; repeated rows
count as often as they stand there. Ties of forms go to the least word in code-point order.
Very long runs are words as others are; a task holds the words of one slice or list. An
empty table gives no rows. Only doc_id and text are read, whatever other columns are called.

Scale. Broadcast are the counts of bigrams, at most 90 * 90. Occurrences are counted before
they are shuffled; the index has 24 postings of about 30 bytes a different word at c = 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, stored
from .wordhash import mix

LEAST, TIMES, Q = 7, 10, 2
LIST = 1_500  #: postings up to which a list is merged at once
FIRST, LAST = 2, 9  #: bigrams in the first index's keys, and in the last one's
CELLS = 1 << 21  #: letters of pairs that are compared at once
LETTERS = 90  #: a-z and U+00C0 to U+00FF
_U = np.uint64


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words and how often they occur; one run in 31, by its hash, has lost a letter."""
    run = F.explode(F.regexp_extract_all("text", F.lit("([A-Za-zÀ-ÿ]+)"), F.lit(1))).alias("run")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run).filter(F.length("run") >= LEAST)
    runs = runs.withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % 31 == 0, short).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")


def letters_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The letters of an Arrow column of words, one after the other as Latin-1, and the words' lengths."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    cuts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[cuts[0] : cuts[-1]] if raw is not None else np.empty(0, np.uint8)
    lead = data == 0xC3  # of the letters from U+00C0 on
    size = np.diff(cuts) - np.diff(np.concatenate([[0], np.cumsum(lead)])[cuts - cuts[0]])
    after = np.zeros(len(data), bool)
    after[1:] = lead[:-1]
    return (data + 0x40 * after.astype(np.uint8))[~lead], size


def by_length(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """length, which words of an Arrow column have it, and their letters, a row a word."""
    flat, size = letters_of(column)
    start = np.cumsum(size) - size
    for n in np.unique(size).tolist():
        whole, step = np.flatnonzero(size == n), max(1, CELLS // n)
        for at in (whole[i : i + step] for i in range(0, len(whole), step)):
            yield n, at, flat[start[at][:, None] + np.arange(n)]


def bigrams(letters: np.ndarray) -> np.ndarray:
    code = np.where(letters < 128, letters.astype(np.int16) - 97, letters.astype(np.int16) - 0xC0 + 26)
    return code[:, :-1] * LETTERS + code[:, 1:]


def rarity(words: DataFrame) -> np.ndarray:
    """By bigram: its place in the order of how many times words hold it; the unseen ones stand first."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n = np.zeros(LETTERS * LETTERS, np.int64)
        for batch in batches:
            for _, _, letters in by_length(batch.column(0)):
                n += np.bincount(bigrams(letters).ravel(), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["gram", "n"])

    n = np.zeros(LETTERS * LETTERS, np.int64)
    for gram, k in words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():  # at most 8100 rows
        n[gram] = k
    place = np.empty(len(n), np.int64)
    place[np.argsort(n, kind="stable")] = np.arange(len(n))
    return place


def rarest(letters: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The k first bigrams of each word, as place * 2^32 + position; fewer where the words are shorter."""
    return np.sort((place[bigrams(letters)] << 32) + np.arange(letters.shape[1] - 1), axis=1)[:, :k]


def hashed(length: int, codes: np.ndarray) -> np.ndarray:
    """A key for each row of codes, whose order doesn't matter."""
    with np.errstate(over="ignore"):
        h = mix(codes.astype(_U) + _U(0x9E3779B97F4A7C15)).sum(axis=1, dtype=_U)
        return mix(h + _U(length) * _U(0xBF58476D1CE4E5B9)).view(np.int64)


def postings(letters: np.ndarray, place: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one length: word, key, the key's length, and which combination of bigrams it is (-1: posted a letter shorter)."""
    m, n = letters.shape
    codes = rarest(letters, place, c + Q)
    rows = np.arange(m)
    out = []
    combos = list(combinations(range(codes.shape[1]), c))
    for k, combo in enumerate(combos):
        out.append((rows, hashed(n, codes[:, combo]), np.full(m, n), np.full(m, k)))
    if n > LEAST:
        keys = []
        for combo in combos:
            some = codes[:, combo]
            some = np.take_along_axis(some, np.argsort(some & 0xFFFFFFFF, axis=1), axis=1)  # by position
            keys += [hashed(n - 1, some - (np.arange(c) >= t)) for t in range(c + 1)]
        key = np.sort(np.stack(keys, axis=1), axis=1)
        new = np.ones(key.shape, bool)
        new[:, 1:] = key[:, 1:] != key[:, :-1]
        row, col = np.nonzero(new)
        out.append((row, key[row, col], np.full(len(row), n - 1), np.full(len(row), -1)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a and b, the latter as long or a letter longer, differ by exactly one edit."""
    n = a.shape[1]
    same = a == b[:, :n]
    if b.shape[1] == n:
        return same.sum(axis=1) == n - 1
    front = np.where(same.all(axis=1), n, np.argmin(same, axis=1))
    tail = a[:, ::-1] == b[:, :0:-1]
    back = np.where(tail.all(axis=1), n, np.argmin(tail, axis=1))
    return front + back >= n


class Lists:
    """Merges the posting lists of one length: words a that have it, and words b a letter longer."""

    def __init__(self, c: int, length: int, place: np.ndarray):
        self.c, self.length, self.place, self.step = c, length, place, max(1, CELLS // length)
        self.first = {}
        for level in range(FIRST, c + 1):
            k = min(level + Q, length - 1)
            table = np.full(1 << (k + 1), 1 << 20)
            number = {combo: i for i, combo in enumerate(combinations(range(k), level))}
            for mask in range(1 << k):
                bits = tuple(i for i in range(k) if mask >> i & 1)[:level]
                table[mask] = number.get(bits, 1 << 20)
            self.first[level] = table

    def combination(self, level: int, a: np.ndarray, b: np.ndarray, longer: bool) -> np.ndarray:
        """For each pair of words: the number, among a's combinations, of the first one whose key both have."""
        x, y = rarest(a, self.place, level + Q), rarest(b, self.place, level + Q)
        same = (x[:, :, None] == y[:, None, :]).any(axis=2)
        bit = 1 << np.arange(x.shape[1])
        if not longer:
            return self.first[level][same @ bit]
        moved = (x[:, :, None] + 1 == y[:, None, :]).any(axis=2)
        at = x & 0xFFFFFFFF
        found = self.first[level][same @ bit]
        for t in range(x.shape[1]):  # bigrams from the t-th one's position on are moved
            found = np.minimum(found, self.first[level][np.where(at < at[:, t : t + 1], same, moved) @ bit])
        return found

    def counted(self, a: np.ndarray, b: np.ndarray, ci: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Which pairs (a: as letters, ci: the combination of a's posting, hot: a's lists of earlier c that weren't merged) count here."""
        longer = b.shape[1] > a.shape[1]
        good = np.flatnonzero(one_edit(a, b))
        for level in range(FIRST, self.c + 1):
            k = self.combination(level, a[good], b[good], longer)
            good = good[k == ci[good] if level == self.c else (hot[good, level - FIRST] >> np.minimum(k, 62)) & 1 == 1]
        return good

    def merge(self, key: np.ndarray, letters: np.ndarray, other: np.ndarray, ci: np.ndarray, hot: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For postings sorted by key: near words, and the least order among them. letters: of a, other: of b; a row each for every posting."""
        n = len(key)
        near, best = np.zeros(n, np.int64), np.full(n, 1 << 40)

        def take(i: np.ndarray, j: np.ndarray) -> None:
            for longer in (False, True):
                pick = np.flatnonzero((ci[i] >= 0) & ((ci[j] < 0) == longer))
                for at in range(0, len(pick), self.step):
                    x, y = i[pick[at : at + self.step]], j[pick[at : at + self.step]]
                    good = self.counted(letters[x], (other if longer else letters)[y], ci[x], hot[x])
                    for p, q in ((x[good], y[good]), (y[good], x[good])):
                        np.add.at(near, p, 1)
                        np.minimum.at(best, p, order[q])

        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, n])
        grams = [bigrams(x) if x.shape[1] > 1 else x for x in (letters, other)]
        small = np.repeat((size > 1) & (size <= 48), size)
        at = np.flatnonzero(small)
        for d in range(1, 48):
            i = at[:-d] if d < len(at) else at[:0]
            i = i[(i + d < n)]
            i = i[key[i] == key[i + d]]
            if not len(i):
                break
            # longer words stand behind the others of their key
            for part in range(0, len(i), self.step):
                x = i[part : part + self.step]
                self.pairs(grams, x, x + d, ci, take)
        for s, m in zip(starts[size > 48].tolist(), size[size > 48].tolist(), strict=True):
            cut = int(np.searchsorted(ci[s : s + m] < 0, True))
            for lo in range(0, cut, LIST):
                a = np.arange(s + lo, s + min(lo + LIST, cut))
                for hi in range(0, m, LIST):
                    b = np.arange(s + max(hi, lo), s + min(hi + LIST, m))
                    for longer, part in ((False, b[ci[b] >= 0]), (True, b[ci[b] < 0])):
                        if len(part):
                            x, y = self.block(grams, a, part, longer)
                            keep = x < y
                            take(x[keep], y[keep])
        return near, best

    def pairs(self, grams, i, j, ci, take) -> None:
        """The count filter for pairs of postings."""
        keep = []
        for longer in (False, True):
            p = np.flatnonzero((ci[i] >= 0) & ((ci[j] < 0) == longer))
            x = grams[0][i[p]]
            if longer:
                y = grams[1][j[p]]
                shared = ((x == y[:, :-1]) | (x == y[:, 1:])).sum(axis=1)
            else:
                shared = (x == grams[0][j[p]]).sum(axis=1)
            keep.append(p[shared >= self.length + longer - 3])
        keep = np.concatenate(keep)
        take(i[keep], j[keep])

    def block(self, grams, a, b, longer) -> tuple[np.ndarray, np.ndarray]:
        """The count filter for all of a against all of b: positions are merged one by one into numbers."""
        shared = np.zeros((len(a), len(b)), np.int32)
        x, y = grams[0][a].T.copy(), grams[int(longer)][b].T.copy()
        for p in range(len(x)):
            same = x[p][:, None] == y[p][None, :]
            if longer:
                same |= x[p][:, None] == y[p + 1][None, :]
            shared += same
        i, j = np.nonzero(shared >= self.length + longer - 3)
        return a[i], b[j]


def indexed(words: DataFrame, place: np.ndarray, c: int) -> DataFrame:
    """words (word, n, hot) as postings: key, length, ci, word, n, hot."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                for _, who, letters in by_length(part.column(0)):
                    row, key, length, ci = postings(letters, place, c)
                    pick = pa.array(who[row])
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(length.astype(np.int32)), pa.array(ci.astype(np.int16)), part.column(0).take(pick), part.column(1).take(pick), part.column(2).take(pick)], names=["key", "length", "ci", "word", "n", "hot"])

    return words.select("word", "n", "hot").mapInArrow(run, "key long, length int, ci short, word string, n long, hot array<long>")


FOUND = "word string, near long, best_n long, best string, hot long"


def merged(index: DataFrame, place: np.ndarray, c: int, most: int) -> DataFrame:
    """A row for each posting with near words (near, best_n, best), and for each one whose list was passed on (hot: the combination as a bit, 0 for a longer word)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        lists: dict[int, Lists] = {}

        def table(words, near, best_n, best, hot) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip((words, near, best_n, best, hot), kinds, strict=True)], names=["word", "near", "best_n", "best", "hot"])

        def passed_on(rows: pa.Table) -> pa.RecordBatch:
            ci = rows["ci"].to_numpy()
            none = pa.nulls(len(ci))
            return table(rows["word"].combine_chunks(), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.string()), np.where(ci < 0, 0, np.left_shift(1, np.maximum(ci, 0).astype(np.int64))))

        def out(rows: pa.Table) -> Iterator:
            """Whole lists, sorted by length, key and falling ci."""
            length = rows["length"].to_numpy()
            for n in np.unique(length).tolist():
                part = rows.slice(int(np.searchsorted(length, n)), int((length == n).sum()))
                key, ci = part["key"].to_numpy(), part["ci"].to_numpy()
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                size = np.diff(np.r_[starts, len(key)])
                last = c >= min(n - 3, LAST)
                if not last and (size > most).any():
                    yield passed_on(part.take(np.flatnonzero(np.repeat(size > most, size))))
                keep = np.repeat((size > 1) & ((size <= most) | last), size)
                if not keep.any():
                    continue
                part = part.take(np.flatnonzero(keep))
                key, ci = part["key"].to_numpy(), part["ci"].to_numpy().astype(np.int64)
                count, flat = part["n"].to_numpy(), letters_of(part["word"])[0]
                longer = np.repeat(ci < 0, n + (ci < 0))
                letters, other = (np.full((len(part), n + k), 97, np.uint8) for k in (0, 1))
                letters[ci >= 0] = flat[~longer].reshape(-1, n)
                other[ci < 0] = flat[longer].reshape(-1, n + 1)
                hot = part["hot"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), c - FIRST)
                by = pc.sort_indices(part, [("n", "descending"), ("word", "ascending")]).to_numpy()
                order = np.empty(len(by), np.int64)
                order[by] = np.arange(len(by))
                if n not in lists:
                    lists[n] = Lists(c, n, place)
                near, best = lists[n].merge(key, letters, other, ci, hot, order)
                some = np.flatnonzero(near)
                if len(some):
                    top = by[best[some]]
                    yield table(part["word"].take(some).combine_chunks(), near[some], count[top], part["word"].take(top).combine_chunks(), pa.nulls(len(some)).cast(pa.int64()))

        held: list[pa.Table] = []
        n_held = fresh = 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            held.append(t)
            n_held += t.num_rows
            fresh += t.nbytes
            if fresh < 2 << 20:
                continue
            fresh = 0
            rows = pa.concat_tables(held).combine_chunks()
            key, length = rows["key"].to_numpy(), rows["length"].to_numpy()
            cut = int(np.flatnonzero((key != key[-1]) | (length != length[-1]))[-1]) + 1 if (key[0], length[0]) != (key[-1], length[-1]) else 0
            if cut:
                yield from out(rows.slice(0, cut))
            held = [rows.slice(cut)]
            n_held = len(rows) - cut
            if n_held > 2 * most and c < min(length[-1] - 3, LAST):  # what is passed on needn't be held
                yield passed_on(held[0].slice(0, n_held - most - 1))
                held, n_held = [held[0].slice(n_held - most - 1)], most + 1
        if held:
            yield from out(pa.concat_tables(held).combine_chunks())

    few = index.repartition("key").sortWithinPartitions("length", "key", F.col("ci").desc())
    return few.mapInArrow(run, FOUND)


def near_words(words: DataFrame, most: int = LIST) -> DataFrame:
    """words (word, n) with near words: word, n_near, best_n, best."""
    place = rarity(words)
    left, found, c = words.withColumn("hot", F.array().cast("array<long>")), None, FIRST
    while True:
        each = stored(merged(indexed(left, place, c), place, c, most))
        part = each.filter("hot is null")
        found = part if found is None else found.unionByName(part)
        again = each.filter("hot is not null").groupBy("word").agg(F.bit_or("hot").alias("_hot"))
        if again.isEmpty():
            break
        left = stored(left.join(again, "word").withColumn("hot", F.concat("hot", F.array("_hot"))).drop("_hot"))
        c += 1
    least = F.min(F.struct((-F.col("best_n")).alias("k"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), least.alias("_b")).select("word", "n_near", (-F.col("_b.k")).alias("best_n"), F.col("_b.best").alias("best"))


def variants(docs: DataFrame) -> DataFrame:
    """op11: word, form, root, n, n_near, form_n."""
    words = stored(vocabulary(docs))
    near = near_words(words)
    form = F.col("best_n") >= TIMES * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n"))
    rows = stored(rows)
    # forms grow tenfold at each step, so there are few steps
    forms = rows.filter("form is not null").select("word", "form")
    last = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        step = last.join(forms.select(F.col("word").alias("root"), F.col("form").alias("_next")), "root", "left")
        step = checkpointed(step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on")))
        last = step.select("word", "root")
        if step.filter("_on").isEmpty():
            break
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
