"""op11: against plain pairs of words, and its odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandlake.llm import spelling


def plain_vocabulary(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    """word: form, root, n, n_near, form_n."""
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def random_documents(n, seed):
    rng = random.Random(seed)
    parts = ["ana", "tio", "n", "ü", "ber", "the", "éa", "aaa", "ba"]
    return [(i, " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(2, 5))).title() for _ in range(rng.randrange(0, 60)))) for i in range(n)]


def test_variants_against_plain_pairs(spark):
    docs = random_documents(200, 1)
    docs += [(500 + i, "Wonderful wonderful " * 30) for i in range(2)] + [(600, "wonderfull wonderfull wonderfu1l wondrful wondrful"), (600, "wonderfull"), (None, "wonderfull Straße straßen straßen"), (7, None), (8, ""), (9, "×÷×÷×÷× ×÷×÷×÷×")]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, word string, n int")
    expected = plain(plain_vocabulary(docs))
    assert sum(x[3] for x in expected.values()) > 100 and any(x[0] for x in expected.values())
    assert rows(spelling.variants(df)) == expected


@pytest.mark.parametrize("most", [1500, 6])
def test_long_lists_are_passed_on(spark, most):
    rng = random.Random(2)
    words = {"".join(rng.choice(["ab", "ba", "aa"]) for _ in range(rng.randrange(4, 8))): rng.randrange(2, 99) for _ in range(250)}
    words |= {"a" * k: k for k in range(7, 30)} | {"ab" * 900: 5, "ab" * 900 + "a": 60, "ab" * 450 + "c" + "ab" * 450: 2}
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), most).collect()}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    assert got == {w: (len(x), *min(((words[v], v) for v in x), key=lambda p: (-p[0], p[1]))) for w, x in near.items() if x}


def test_roots_follow_forms(spark):
    text = " ".join(["misteries"] * 2 + ["mysteries"] * 30 + ["mysteriex"] * 400)
    df = spark.createDataFrame([(3, text)], "doc_id long, text string")
    words = plain_vocabulary([(3, text)])
    assert rows(spelling.variants(df)) == plain(words)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")).count() == 0


def test_query_over_the_table(spark, data):
    from strandlake.llm import queries

    docs = spark.read.parquet(f"{data}/documents.parquet")
    words = plain_vocabulary([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = queries.queries()["op11_spelling"](spark, data)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    kept = {r["word"]: r["n"] for r in got.select("word", "n").collect()}
    assert kept == words
    some = dict(sorted(words.items())[:400])
    near = rows(got.filter(F.col("word").isin(list(some))))
    for w in some:
        assert near[w][3] == sum(one_edit(w, v) for v in words if abs(len(v) - len(w)) < 2)
