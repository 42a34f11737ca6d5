"""Each operator against a brute-force version or a round trip, and its edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import components, decontam, langid, packing, pii, rules, simhash, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [words(rng, rng.randrange(10, 90)) for _ in range(12)]
    shared = words(rng, 30)
    out = [None, "", "   ", "a", "\n\n", "word " * 3000, base[0], base[0], base[0] + " tail"]
    out += [f"{words(rng, 5)} {shared} {words(rng, 7)}" for _ in range(6)] + base
    t = base[3].split()
    t[len(t) // 2] = "changed"
    return [*out, " ".join(t), "Ünï çödé text here  with   spaces \n x", "x" * 50_000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ("en", "de", None)[i % 3], "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    return df.withColumn("score", F.lit("x")).withColumn("n_words", F.lit("y")).withColumn("spans", F.lit(1)).withColumn("id", F.lit(0)).withColumn("th", F.lit(0))


def test_pii_base_against_plain_patterns():
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(t):
        out = []
        for k, kind in enumerate(pii.BASE):
            for m in re.finditer(plain[kind], t):
                d = re.sub("[^0-9]", "", m[0])
                ok = kind == "email" or (kind == "ip" and all(int(x) < 256 for x in m[0].split("."))) or (kind == "card" and 12 <= len(d) <= 19 and pii.luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)
                if ok:
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    rng = random.Random(3)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111112", "+1 (017) 555-7713", "+12", " ", "-", "é", "%", ".", "7", "\n"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert pii.spans(t)[0] == brute(t), t


def test_pii_further_kinds():
    t = "account GB82 WEST 1234 5698 7654 32, ssn 123-45-6789, order 123-45-6789"
    kinds = [pii.KINDS[k] for _, k, _ in pii.spans(t)[1]]
    assert kinds.count("iban") == 1 and "ssn" in kinds
    assert not pii.spans("GB82 WEST 1234 5698 7654 33")[1] and not pii.spans("part 123-45-6789")[1]
    assert pii.redacted("mail a@b.co now", pii.spans("mail a@b.co now")[1]) == "mail <EMAIL> now"
    assert len(pii.spans("1" * 200_000 + "@" * 1000 + "+" * 1000)[1]) == 0


def test_pii_query(docs, empty):
    rows = pii.digest(clashing(docs)).collect()
    assert len(rows) == docs.count() and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    assert pii.digest(empty).count() == 0
    assert pii.stage(docs).columns == docs.columns


def test_dictionaries_are_whole_texts(spark, data, texts):
    """Against a plain version: whole texts in hash order, short ones first; the smallest size wins."""
    import zstandard as z

    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("h")).collect()
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    want = {}
    for lang in {r.lang for r in train}:
        drawn = sorted((r for r in train if r.lang == lang), key=lambda r: (len(r.text.encode()) > 20_000 // 64, r.h, r.doc_id))
        content, size = b"", 0
        for r in drawn:
            if size < 20_000:
                content += langid.plain(r.text) + b" "
            size += len(r.text.encode())
        want[lang] = content[:20_000]
    d = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string")
    model = langid.fit(d.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"), dict_bytes=20_000)
    assert model == want
    few = langid.fit(d.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"), docs_per_lang=5)
    for lang, content in few.items():
        drawn = sorted((r for r in train if r.lang == lang), key=lambda r: (len(r.text.encode()) > 114688 // 64, r.h, r.doc_id))[:5]
        assert content == b"".join(langid.plain(r.text) + b" " for r in drawn)
    with pytest.raises(ValueError):
        langid.fit(d, max_langs=2)
    how = z.ZstdCompressionParameters.from_level(3, min_match=3, strategy=z.STRATEGY_GREEDY, write_content_size=False, write_dict_id=False)
    using = {k: z.ZstdCompressor(dict_data=z.ZstdCompressionDict(v, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how) for k, v in want.items()}
    for r in langid.predict(d, model).collect():
        raw = langid.plain(r.text)
        total = {k: sum(len(c.compress(raw[i : i + langid.BLOCK])) for i in range(0, len(raw), langid.BLOCK)) for k, c in using.items()}
        best, rest = sorted(total.items(), key=lambda x: (x[1], x[0]))[:2]
        assert (r.lang_pred, r.score) == (best[0], pytest.approx(1 - best[1] / rest[1])) or not re.search(r"[^\W\d_]", r.text)


def test_language(spark, data, docs, empty):
    d = spark.read.parquet(f"{data}/documents.parquet")
    rows = langid.digest(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in langid.digest(clashing(docs)).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[2].lang_pred == "und" and odd[3].lang_pred in ("en", "de")
    assert langid.digest(empty).count() == 0
    assert langid.predict(docs, {}).filter("lang_pred <> 'und'").count() == 0


def brute_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a in nodes:
        for b in nodes:
            if linked(a, b):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash(docs, texts, empty):
    rows = {r.doc_id: r for r in simhash.digest(clashing(docs)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in rows.items()} == prints
    want = brute_components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {i: r.component_id for i, r in rows.items()} == want
    assert simhash.digest(empty).count() == 0
    kept = simhash.stage(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


def test_anchors_lose_no_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    x = [b ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, k, replace=False))) for b in base for k in range(7)]
    x = np.unique(np.array(x, np.uint64))
    key, v = simhash.replicate(x)
    order = np.argsort(key, kind="stable")
    a, b = simhash.links(key[order], v[order])
    got = {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(int(i), int(j)) for i in x for j in x if i < j and int(i ^ j).bit_count() <= 4}
    assert got == want


def test_large_buckets_keep_their_links():
    rng = random.Random(2)
    chain = [0]
    for _ in range(150):
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 4)))
    x = np.array(chain, np.uint64)
    a, b = simhash.links(np.zeros(len(x), np.uint64), x)
    top = brute_components(sorted(set(chain)), lambda p, q: (p ^ q).bit_count() <= 4)
    got = brute_components(sorted(set(chain)), lambda p, q, s={*zip(a.tolist(), b.tolist(), strict=True)}: (p, q) in s)
    assert got == top


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    rows = components.connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_encoder_equals_the_tokenizer():
    """In its default setting, text by text and many at once, remembering words and forgetting them."""
    import public_tokenizers as P
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own, rng = packing.Encoder(added=packing.added_tokens(), keep=40), random.Random(1)
    parts = ["ab", "The", " ", "  ", "\n", "\t", ",", "é", "12", "'s", "\u00a0", "<|endoftext|>", "\x1c", "ß", "\u3000", "\u2003", "\x85", "Über"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(3000)), *(" ".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(1000))]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert [own.encode(x).tolist() for x in texts] == want
    assert [x.tolist() for k in range(0, len(texts), 500) for x in own.encode_all(pa.array(texts[k : k + 500]))] == want


def test_packing(docs, texts, empty):
    own = packing.Encoder()
    ids = {i: np.append(own.encode(t), 1).astype("<u4") for i, t in enumerate(texts)}
    rows = packing.pack(clashing(docs)).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    for i, x in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(x)
    for own_rows in by_sequence.values():
        at = 0
        for r in sorted(own_rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(empty).count() == 0


def test_scores_are_bm25():
    """By all ids of the seed, frequent ones too."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 60, rng.integers(5, 40)).astype("<u2") for _ in range(30)]
    idf = rng.random(packing.VOCABULARY).astype(np.float32) + 0.1
    shard = packing.Shard(texts, idf)
    assert 0 < len(shard.rows) < 60
    mean = np.mean([len(t) for t in texts])
    for seed in (4, 9):
        want = []
        for i, t in enumerate(texts):
            tf = collections.Counter(t.tolist())
            want.append(0 if i == seed else sum(idf[q] * tf[q] * (packing.K1 + 1) / (tf[q] + packing.K1 * (1 - packing.B + packing.B * len(t) / mean)) for q in set(texts[seed].tolist())))
        assert shard.scores(seed) == pytest.approx(want, rel=1e-5)
    window = next(shard.windows())
    best = max((i for i in range(30) if i), key=lambda i: packing.Shard(texts, idf).scores(0)[i])
    assert window[0][0] == 0 and window[1][0] == best


def brute_dedup(texts):
    seen, out = set(), []
    for t in texts:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                keep[i : i + 20] = [False] * 20
            seen.add(k)
        out.append((len(w), keep.count(False), hashlib.sha256(b" ".join(x for x, k in zip(w, keep, strict=True) if k)).hexdigest()))
    return out


def test_substrings(docs, texts, empty):
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(clashing(docs)).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_dedup(texts)
    assert substrings.digest(empty).count() == 0


def test_substrings_of_small_alphabets(spark):
    rng = random.Random(11)
    texts = [words(rng, rng.randrange(15, 160), 2) for _ in range(40)]
    block = words(rng, 45, 2)
    texts += [f"{words(rng, 9, 2)} {block} {words(rng, 9, 2)}" for _ in range(6)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(d).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_dedup(texts)


@pytest.mark.parametrize(("crowded", "hot"), [(0, 0), (0, 10**9), (9, 20)])
def test_crowded_anchors_leave_the_automaton(spark, texts, monkeypatch, crowded, hot):
    """A passage that starts after different words in many documents: no automaton takes over CROWDED passages."""
    rng = random.Random(11)
    shared = words(rng, 40, 10**6)
    many = [*texts, *(f"{words(rng, 30, 10**6)} {shared} {words(rng, 30, 10**6)}" for _ in range(60))]
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    monkeypatch.setattr(substrings, "HOT", hot)
    seen, resolve = [], substrings.resolve
    monkeypatch.setattr(substrings, "resolve", lambda found: seen.append(found.groupBy("anchor").count().agg(F.max("count")).first()[0] or 0) or resolve(found))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(many)], "doc_id long, text string").repartition(3)
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(df).collect()}
    assert [rows[i] for i in range(len(many))] == brute_dedup(many)
    assert max(seen) <= crowded


def test_repeated_rows_keep_what_one_keeps(spark):
    t = words(random.Random(1), 40)
    rows = substrings.digest(spark.createDataFrame([(1, t), (1, t), (2, t), (None, "short")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, 40)]


def test_reference_spans(spark):
    d = spark.createDataFrame([(1, "x a b c d e y"), (2, "a b z")], "doc_id long, text string")
    ref = spark.createDataFrame([("q a b c d e r",), (None,)], "text string")
    assert {r.doc_id: r.kept_text for r in substrings.reference_spans(d, ref, 4).collect()} == {1: "x y", 2: "a b z"}
    with pytest.raises(ValueError):
        substrings.reference_spans(d, ref, 4, max_words=3)


def test_automaton_against_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        seqs, q = [[rng.randrange(3) for _ in range(rng.randrange(9))] for _ in range(3)], [rng.randrange(3) for _ in range(12)]
        a = substrings.Automaton()
        for s in seqs:
            a.add(s)
        subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        assert a.statistics(q) == [max((n for n in range(1, e + 2) if tuple(q[e + 1 - n : e + 1]) in subs), default=0) for e in range(len(q))]


def test_decontamination(spark, data, same, docs, empty):
    d, b = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "benchmark"))
    same(decontam.digest(d, b), decontam.SQL)
    items = spark.createDataFrame([(1, "W5"), (2, "a"), (3, None), (4, "!!"), (5, "x" * 50_000), (5, "a")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.digest(clashing(docs), items).collect()}
    assert rows[3].n_hit == 1 and rows[3].n_items == 2 and rows[0].n_words == 0 and not rows[1].contaminated
    assert rows[docs.count() - 1].n_items == 1
    assert decontam.digest(docs, items.limit(0)).filter("contaminated").count() == 0
    assert decontam.digest(empty, items).count() == 0
    assert decontam.stage(docs, items).columns == docs.columns


def test_decontamination_in_blocks(spark, data, monkeypatch):
    d, b = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "benchmark"))
    whole = sorted(map(str, decontam.digest(d, b).collect()))
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 400)
    assert sorted(map(str, decontam.digest(d, b).collect())) == whole


def brute_near(texts, items):
    """Document -> items with a proximity match and no exact one."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [split(t) for t in texts]
    count = collections.Counter(w for d in docs for w in d)
    out = []
    for d in docs:
        near, exact = set(), set()
        for item, t in items:
            w = split(t)
            for i in range(max(len(w) - 9, 1) if w else 0):
                g = w[i : i + 10]
                m = len(g)
                if any(d[j : j + m] == g for j in range(len(d) - m + 1)):
                    exact.add(item)
                for off in sorted(range(m), key=lambda o: (count[g[o]], o))[:3]:
                    for p in (p for p, x in enumerate(d) if x == g[off]):
                        places = range(max(p - off - 2, 0), min(p - off + m + 2, len(d)))
                        if sum(any(g[o] == d[q] and abs(q - (p - off) - o) <= 2 for o in range(m)) for q in places) >= -(-4 * m // 5):
                            near.add(item)
        out.append(near - exact)
    return out


def test_near_matches(spark):
    item = "one two three four five six seven eight nine ten"
    rng = random.Random(8)
    texts = [f"x {item} y", "one two three four FOREIGN five six seven eight nine ten", "one two three four five zz seven eight nine yy", "one two three four five zz yy xx nine ten", None, "ten nine eight seven six", "p q", "q a p"]
    texts += [words(rng, rng.randrange(40), 12) for _ in range(25)]
    items = [(7, item), (8, "p q"), (9, words(rng, 12, 12)), (10, words(rng, 14, 12)), (11, words(rng, 5, 12))]
    want = brute_near(texts, items)
    assert want[1] == want[2] == {7} and not want[0] and not want[3] and sum(map(len, want[8:])) > 3
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.contamination(d, b).collect()}
    assert [rows[i].n_near for i in range(len(texts))] == [len(x) for x in want]
    assert rows[0].n_hit == 10 and rows[0].item_ids == ["7"] and rows[1].n_hit == 0


def test_long_stretches_are_cut(spark, monkeypatch):
    """Matches over the borders of stored pieces are found, once."""
    monkeypatch.setattr(decontam, "PIECE", 16)
    rng = random.Random(5)
    texts = [words(rng, 400, 6) for _ in range(4)]
    items = [(1, " ".join(texts[0].split()[10:24])), (2, " ".join(texts[1].split()[90:95]))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(str, decontam.digest(d, b).collect()))
    monkeypatch.setattr(decontam, "PIECE", 1 << 16)
    assert sorted(map(str, decontam.digest(d, b).collect())) == got
    assert [r.n_near for r in sorted(decontam.contamination(d, b).collect(), key=lambda r: r.doc_id)] == [len(x) for x in brute_near(texts, items)]


def test_quality(spark, data, same, docs, empty):
    d, labels = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    same(rules.digest(d, labels), rules.SQL)
    rows = {r.doc_id: r for r in rules.digest(clashing(docs), labels.limit(0)).collect()}
    assert rows[0].n_words == 0 and rows[0].base_failed and rows[5].n_repeat_words == 3000 and not rows[5].kept
    assert rules.digest(empty, labels).count() == 0
    odd = d.selectExpr("*", "1 as n_words", "2 as kept", "3 as stratum", "4 as m")
    stay = rules.stage(odd, labels)
    assert stay.columns == odd.columns
    assert sorted(r.doc_id for r in stay.select("doc_id").collect()) == sorted(r.doc_id for r in rules.digest(d, labels).filter("kept").collect())


def test_rules_reject_beyond_the_base(spark):
    """With some hundred labelled documents the method's verdict differs from the base rules', as its SQL says."""
    import duckdb

    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    con = duckdb.connect()
    for n in ("documents", "labels"):
        con.sql(f"create view {n} as from '/root/testdata/sf0.01/{n}.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from ({rules.SQL})").fetchall()}
    got = {r[0]: tuple(r[1:]) for r in rules.digest(d, labels).collect()}
    assert got == want and sum(not r[5] and not r[6] for r in got.values()) > 20


def measured(spark, ratios):
    rows = [(i, "en", 100, 500, s, 10, dup, 0, False) for i, (s, dup) in enumerate(ratios)]
    m = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    return m, spark.createDataFrame([(i, 1) for i in range(len(rows))], "doc_id long, quality int")


def tail(n, k, a):
    return sum(math.comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1))


def test_steps_are_exact_binomial(spark):
    """The walk goes on while the exact test admits it, and the union of all rules counts."""
    n = 400
    ratios = [(250 if i < 2 else 35 if i < 5 else 2, 6 if i in (5, 6) else 0) for i in range(n)]
    m, labels = measured(spark, ratios)
    first = []
    for s, dup in ratios:
        steps = [sum(c >= x for c in rules.RULES[r][1]) * 5 + j for j, (r, x) in enumerate({"symbols": s / 100, "dup_lines": dup / 10, "repeats": 0.0, "long_words": 5.0, "short_words": 0.2}.items()) if x > rules.RULES[r][1][-1]]
        first.append(min(steps, default=rules.STEPS))
    want = next((t for t in range(rules.STEPS) if tail(n, sum(f <= t for f in first), rules.ALPHA) > rules.DELTA), rules.STEPS)
    (r,) = rules.admitted(m, labels).collect()
    assert (r.stratum, r.n, r.steps) == ("en", n, want) and 5 < want < rules.STEPS
    cut = {x.rule: x.cutoff for x in rules.cutoffs(m, labels).collect()}
    assert cut["symbols"] == rules.RULES["symbols"][1][(want - 1) // 5]
    assert rules.admitted(m, labels.limit(20)).count() == 0


def test_false_rejections_stay_below_alpha(spark):
    """144 good documents let rules act with four strata; fewer do not."""
    assert (1 - rules.ALPHA) ** 144 <= rules.DELTA / 4 < (1 - rules.ALPHA) ** 143
    m, labels = measured(spark, [(0, 0)] * 144)
    assert [r.steps for r in rules.admitted(m, labels).collect()] == [rules.STEPS]


def test_measures_against_plain_counts(spark, monkeypatch):
    """Ends of texts, and windows of equal hash but different words."""
    rng = random.Random(6)
    texts = ["Of Of Of", "f a f", "ff", "a\x0bb\x0cc\rd\te\n\n#$ a", *(words(rng, rng.randrange(60), 3) for _ in range(30)), *("\n".join(rng.choice(["x y", "", " ", "x y "]) for _ in range(6)) for _ in range(10))]

    def plain(t):
        w = [x for x in re.split(r"[ \t-\r]+", t) if x]
        g = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {p for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^ \t-\r]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(again)

    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hashed in ("xxhash64(w[i], w[i + 1], w[i + 2])", "xxhash64(w[i])", "0L"):
        monkeypatch.setattr(rules, "MEASURES", rules.MEASURES.replace("xxhash64(w[i], w[i + 1], w[i + 2])", hashed))
        got = {r.doc_id: tuple(r[n] for n in rules.NAMES) for r in rules.measures(d).collect()}
        assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = {r.doc_id for r in rules.digest(docs, labels).filter("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    top = brute_components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    texts = {i: texts[i] for i in set(top.values())}
    grams = set()
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.encode().lower())
        grams |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))}
    def hit(t):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower())
        return any(tuple(w[i : i + m]) in grams for m in {len(g) for g in grams} for i in range(len(w) - m + 1))

    texts = {i: pii.redacted(t, pii.spans(t)[1]) for i, t in texts.items() if not hit(t)}
    own = packing.Encoder()
    want = {i: len(own.encode(t)) + 1 for i, t in texts.items()}
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, data).collect():
        got[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want
