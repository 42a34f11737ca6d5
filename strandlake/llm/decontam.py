"""Benchmark decontamination with a distributed positional inverted index.

Windows are runs of 10 consecutive item words (a shorter item is one window).

1. The corpus is scanned once for each block of items. What is stored are the stretches in
   which a window can occur, exactly or nearly: those where, of the places that a window of
   m words and SLACK words on either side cover, at least need(m) hold words of windows of
   that length. The scan also counts every window word in the corpus.
2. A stored batch of stretches is a shard of the index: its words, sorted, are posting lists
   of places. Each window looks up its rarest words by corpus counts (ties by offset), their
   lists are shifted by the words' offsets, and what stands at these starts is compared.

An exact phrase match has all words in place. A proximity match has need(m) places (0.8 m,
rounded up) that hold a word which the window has at most SLACK places from there; it starts from one of the RAREST rarest words, of which a match that misses or moves
fewer cannot lack all. n_near counts the items with proximity matches and no exact one.

Broadcast: the words and windows of one block, at most BLOCK_WORDS benchmark words (more
only for one longer item); larger benchmarks take more blocks, each a scan. Nothing is
collected but the windows of a block and their words' counts. Words are compared by 64-bit
hashes.

Null, empty and wordless texts have no words and no hits. Very long texts are scanned whole,
and their stretches stored in pieces that overlap. Null item_ids match as the word 'null',
repeated item_ids count once; an empty benchmark hits nothing, an empty table gives no rows.
Repeated document rows and rows of null doc_id are handled each by itself (a row number made
in the scan tells them apart); only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, columns, free, stored
from .wordhash import NOT_ALNUM, Hasher, slices

SIZE, SLACK, RAREST, BLOCK_WORDS = 10, 2, 3, 200_000
PIECE = 1 << 16  #: words of a stretch in one row


def need(m: int) -> int:
    """Places of a proximity match with a window of m words."""
    return -(-4 * m // 5)



def item_words(items: DataFrame) -> DataFrame:
    """item_id and its words' hashes, for items with words."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hasher = Hasher(NOT_ALNUM, lower=True)
        for batch in batches:
            lists = [h.view(np.int64)[a:b] for s in slices(batch.column(1), hasher) for h, (a, b) in ((s.hashes, x) for x in zip(s.first[:-1], s.first[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["item_id", "words"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    return named.mapInArrow(run, "item_id string, words array<long>").filter("size(words) > 0")


def blocks(items: DataFrame) -> list[DataFrame]:
    """Items in blocks of about BLOCK_WORDS words, by hash of the item."""
    every = checkpointed(item_words(items).distinct())
    total = every.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-total // BLOCK_WORDS)
    return [every.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)]


def windows_of(items: DataFrame) -> DataFrame:
    """wid, words and the items' ids: a row for each different window."""
    each = items.select("item_id", F.expr(f"explode(transform(sequence(0, greatest(size(words) - {SIZE}, 0)), i -> slice(words, i + 1, {SIZE})))").alias("words"))
    return each.groupBy("words").agg(F.collect_set("item_id").alias("items")).select(F.xxhash64("words").alias("wid"), "words", "items")


def scan(docs: DataFrame, vocabulary: dict[int, np.ndarray]) -> DataFrame:
    """vocabulary: window length -> sorted hashes of the words of windows of that length.

    A row for each document (doc_id, rid, n_words), each stretch (doc_id, rid, start, terms)
    and each batch's count of each vocabulary word (term, n).
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        hasher, vocab = Hasher(NOT_ALNUM, lower=True), shipped.value
        every = np.unique(np.concatenate(list(vocab.values()))) if vocab else np.empty(0, np.uint64)
        held = {m: np.isin(every, v) for m, v in vocab.items()}
        counts = np.zeros(len(every), np.int64)
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids = batch.column(0)
            for s in slices(batch.column(1), hasher):
                n = len(s.first) - 1
                rids = np.arange(rid, rid + n)
                rid += n
                yield table(doc_id=ids[s.rows], rid=pa.array(rids), n=pa.array(np.diff(s.first)))
                if not len(every) or not len(s.hashes):
                    continue
                at = np.searchsorted(every, s.hashes)
                at[at == len(every)] = 0
                known = every[at] == s.hashes
                counts += np.bincount(at[known], minlength=len(every))
                keep = np.zeros(len(known), bool)
                edge = np.zeros(len(known) + 1, bool)
                edge[s.first] = True
                ends = np.repeat(s.first[1:], np.diff(s.first))
                for m, member in held.items():
                    so_far = np.r_[0, np.cumsum(known & member[at])]
                    to = np.minimum(np.arange(len(known)) + m + 2 * SLACK, ends)
                    full = np.flatnonzero(so_far[to] - so_far[:-1] >= need(m))
                    step = np.zeros(len(keep) + 1, np.int64)
                    np.add.at(step, full, 1)
                    np.add.at(step, to[full], -1)
                    keep |= np.cumsum(step[:-1]) > 0
                a, b = stretches(keep, edge)
                n = np.maximum(-(-(b - a) // PIECE), 1)
                a = np.repeat(a, n) + PIECE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                b = np.minimum(np.repeat(b, n), a + PIECE + 2 * (SIZE + 2 * SLACK))
                if len(a):
                    d = np.searchsorted(s.first, a, "right") - 1
                    h = s.hashes.view(np.int64)
                    yield table(doc_id=ids[s.rows].take(pa.array(d)), rid=pa.array(rids[d]), start=pa.array(a - s.first[d]), terms=pa.array([h[i:j] for i, j in zip(a, b, strict=True)], pa.list_(pa.int64())))
        some = np.flatnonzero(counts)
        yield table(term=pa.array(every[some].view(np.int64)), n=pa.array(counts[some]))

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("doc_id", "rid", "n", "start", "terms", "term")

    def table(**columns):
        import pyarrow as pa

        n = len(next(iter(columns.values())))
        types = {"rid": pa.int64(), "n": pa.int64(), "start": pa.int64(), "terms": pa.list_(pa.int64()), "term": pa.int64(), "doc_id": id_type}
        return pa.RecordBatch.from_arrays([columns[c].cast(types[c]) if c in columns else pa.nulls(n, types[c]) for c in names], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, rid long, n long, start long, terms array<long>, term long")


def stretches(good: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of good words; a run ends where edge, a document's first word, is set."""
    n = len(good)
    a = np.flatnonzero(good & (edge[:n] | ~np.r_[False, good[:-1]]))
    b = np.flatnonzero(good & (edge[1:] | ~np.r_[good[1:], False])) + 1
    return a, b


def rarest(words: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of windows of one length (a row each): the offsets of their rarest words, by the counts of sorted terms, then by offset."""
    at = np.searchsorted(terms, words) if len(terms) else np.zeros(words.shape, np.int64)
    n = np.where(np.r_[terms, 0][at] == words, np.r_[counts, 0][at], 0)
    return np.argsort(n, axis=1, kind="stable")[:, :RAREST]


def looked_up(stretches_: list[np.ndarray], index: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """index: (window ids, words, rarest offsets) for each length. Yields stretch, place in it, window id, exact or near, length."""
    gap = np.zeros(SIZE + 2 * SLACK, np.int64)
    parts = [gap]
    for x in stretches_:
        parts += [x, gap]
    every = np.concatenate(parts)
    lengths = np.array([len(x) for x in stretches_], np.int64)
    begin = np.cumsum(lengths + len(gap)) - lengths
    real = np.zeros(len(every), bool)
    real[np.repeat(begin, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = True
    places = np.flatnonzero(real)
    places = places[np.argsort(every[places], kind="stable")]  # the posting lists, one after the other
    words = every[places]
    for wid, window, rare in index:
        m = window.shape[1]
        for k in range(rare.shape[1]):
            off = rare[:, k]
            term = window[np.arange(len(window)), off]
            low, high = np.searchsorted(words, term, "left"), np.searchsorted(words, term, "right")
            n = high - low
            total = np.cumsum(n)
            for a in range(0, len(n), 4096):  # windows at a time
                c = n[a : a + 4096]
                if not c.sum():
                    continue
                who = np.repeat(np.arange(a, a + len(c)), c)
                at = places[np.repeat(low[a : a + 4096] - (total[a : a + 4096] - c), c) + np.arange(total[a] - c[0], total[a + len(c) - 1])] - off[who]
                for i in range(0, len(at), 1 << 16):
                    w, p = who[i : i + (1 << 16)], at[i : i + (1 << 16)]
                    around = p[:, None] + np.arange(-SLACK, m + SLACK)
                    inside = (around >= 0) & (around < len(every))
                    around = np.where(inside, around, 0)
                    text, alive = every[around], real[around] & inside
                    hit = np.zeros(text.shape, bool)
                    for d in range(2 * SLACK + 1):
                        same = (text[:, d : d + m] == window[w]) & alive[:, d : d + m]
                        hit[:, d : d + m] |= same
                        if d == SLACK:
                            exact = same.all(axis=1)
                    good = exact | (hit.sum(axis=1) >= need(m))
                    stretch = np.searchsorted(begin, p[good] + off[w[good]], "right") - 1
                    yield stretch, p[good] - begin[stretch], wid[w[good]], exact[good], m


def matches(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of one block of windows: documents (doc_id, rid, n_words); exact matches (rid, start, len, items); near ones (rid, items)."""
    windows = checkpointed(windows)
    by_length: dict[int, list] = {}
    for r in windows.select("wid", "words").collect():
        by_length.setdefault(len(r.words), []).append((r.wid, r.words))
    arrays = {m: (np.array([x for x, _ in v], np.int64), np.array([w for _, w in v], np.int64)) for m, v in by_length.items()}
    found = checkpointed(scan(docs, {m: np.unique(w.view(np.uint64)) for m, (_, w) in arrays.items()}))
    documents = found.filter("term is null and terms is null").select("doc_id", "rid", F.col("n").alias("n_words"))
    counted = sorted((r.term, r.n) for r in found.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect())
    terms, counts = (np.array([r[i] for r in counted], np.int64) for i in (0, 1))
    shipped = docs.sparkSession.sparkContext.broadcast([(wid, w, rarest(w, terms, counts)) for _, (wid, w) in sorted(arrays.items())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rid, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(2)
            flat, cuts = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
            for stretch, place, wid, exact, m in looked_up([flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], shipped.value):
                rows = np.unique(np.stack([rid[stretch], np.where(exact, start[stretch] + place, 0), wid, exact.astype(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows[:3]), pa.array(rows[3].astype(bool)), pa.array(np.full(rows.shape[1], m))], names=["rid", "start", "wid", "exact", "len"])

    looked = found.filter("terms is not null").select("rid", "start", "terms").mapInArrow(run, "rid long, start long, wid long, exact boolean, len long")
    # a block's windows are bounded by BLOCK_WORDS
    cand = checkpointed(looked.join(F.broadcast(windows.select("wid", "items")), "wid"))
    return documents, cand.filter("exact").select("rid", "start", "len", "items"), cand.filter("not exact").select("rid", "items")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, rid, n_words, n_hit, n_items, item_ids (sorted as strings), n_near (items near but not matched), contaminated; a row for each document row."""
    some = blocks(items)
    if len(some) > 1:  # so that every scan numbers the rows alike
        docs = stored(docs.select("doc_id", "text"))
    parts = [matches(docs, windows_of(b)) for b in some]
    if not parts:
        parts = [matches(docs, windows_of(item_words(items.limit(0))))]
    documents = parts[0][0]
    exact = parts[0][1]
    near = parts[0][2]
    for _, e, n in parts[1:]:
        exact, near = exact.union(e), near.union(n)
    # words covered by the union of the matches of a document
    spans = exact.select("rid", "start", (F.col("start") + F.col("len")).alias("end")).groupBy("rid", "start").agg(F.max("end").alias("end"))
    before = F.max("end").over(W.partitionBy("rid").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    hit = spans.withColumn("free", F.greatest("start", F.coalesce(before, F.col("start")))).groupBy("rid").agg(F.sum(F.greatest(F.col("end") - F.col("free"), F.lit(0))).alias("n_hit"))
    ids = exact.select("rid", F.explode("items").alias("item")).distinct().groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    close = near.select("rid", F.explode("items").alias("item")).distinct().groupBy("rid").agg(F.collect_list("item").alias("near_ids"))
    out = documents.join(hit, "rid", "left").join(ids, "rid", "left").join(close, "rid", "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("item_ids", F.coalesce("item_ids", none)).withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
    near_n = F.size(F.array_except(F.coalesce("near_ids", none), "item_ids")).cast("long")
    return out.select("doc_id", "rid", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", near_n.alias("n_near"), (F.col("n_hit") > 0).alias("contaminated"))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """op7."""
    out = contamination(docs, items)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated", "n_near")


def stage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pipeline stage: documents with a hit word go (with them all rows of the same doc_id; rows of null doc_id go by their text)."""
    key = free(docs, "_key")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.sha2("text", 256)), F.lit("none")))
    bad = contamination(keyed.select(F.col(key).alias("doc_id"), "text"), items).filter("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(bad, key, "left_anti").select(*columns(docs))


#: The same in DuckDB.
SQL = rf"""
with dw as (select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda y: y <> '') as w from documents),
bw as (select coalesce(item_id::varchar, 'null') as item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda y: y <> '') as w from benchmark),
bi as (select item_id, least(len(w), {SIZE}) as m, unnest(generate_series(1, greatest(len(w) - {SIZE} + 1, 1))) as i, w from bw where len(w) > 0),
win as (select distinct item_id, m, w[i : i + m - 1] as words, list_aggregate(w[i : i + m - 1], 'string_agg', ' ') as gram from bi),
sizes as (select distinct m from win),
di as (select rid, m, unnest(generate_series(1, len(w) - m + 1)) as i, w from dw, sizes where len(w) >= m),
dg as (select rid, m, i, list_aggregate(w[i : i + m - 1], 'string_agg', ' ') as gram from di),
hits as (select rid, i, m, item_id from dg join win using (m, gram)),
cover as (select rid, count(distinct p) as n_hit from (select rid, unnest(generate_series(i, i + m - 1)) as p from (select distinct rid, i, m from hits)) group by rid),
its as (select rid, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hits group by rid),
dp as (select rid, unnest(generate_series(0, len(w) - 1)) as p, unnest(w) as word from dw where len(w) > 0),
n as (select word, count(*) as c from dp group by word),
slots as (select gram, m, unnest(generate_series(0, m - 1)) as off, unnest(words) as word from (select distinct gram, m, words from win)),
ranked as (select s.*, row_number() over (partition by gram order by coalesce(c, 0), off) as k from slots s left join n using (word)),
starts as (select distinct rid, gram, m, p - off as at from ranked join dp using (word) where k <= {RAREST}),
near as (select rid, gram from (select st.rid, st.gram, st.m, st.at, count(distinct dp.p) as places from starts st join slots sl on sl.gram = st.gram join dp on dp.rid = st.rid and dp.word = sl.word and abs(dp.p - st.at - sl.off) <= {SLACK} group by all) where places >= (4 * m + 4) // 5),
close as (select rid, count(distinct item_id) as n_near from (select rid, item_id from near join win using (gram) except select rid, item_id from hits) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0)::bigint as n_near
from dw left join cover using (rid) left join its using (rid) left join close using (rid)
"""
