"""Every stage of the pipeline, and operators, on nulls, repeated and very long rows, clashing names and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import common, decontam, lm, packing, simhash, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use within.
NAMES = ("_key", "_m", "_steps", "_stratum", "_hot", "_th", "th", "fp", "root", "n", "n_words", "n_email", "pii_spans", "kept", "score", "id", "start", "a.b", "c`d")


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    prose = [" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(4)]
    texts = [None, "", " \n", *prose, prose[0], "mail a.b@c.de " + prose[1][::-1], " ".join(f"v{rng.randrange(10**6)}" for _ in range(60_000))]
    rows = [(i, t, ("en", None)[i % 2], None, len(t) if t else None) for i, t in enumerate(texts)]
    rows += [(3, prose[0], "en", "s", 1), (None, prose[2] + " more", None, None, None), (None, None, None, None, None), (None, prose[2] + " more", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in NAMES:
        df = df.withColumn(name, F.lit(f"of {name}"))
    return df


def others(row):
    return [row[n] for n in NAMES]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stages_pass_columns_and_rows(spark, data, odd, name, stage):
    out = stage(spark, odd, data)
    assert out.columns == odd.columns and [f.dataType for f in out.schema.fields] == [f.dataType for f in odd.schema.fields]
    rows = out.collect()
    assert all(others(r) == [f"of {n}" for n in NAMES] for r in rows)
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    want = {
        "quality_rules": [3, 3, 4, 5, 6, 7, 8, 9, None, None],
        "simhash_near_dedup": None,
        "benchmark_decontamination": [*range(10), 3, None, None, None],
        "pii": [*range(10), 3, None, None, None],
    }[name]
    if want:
        assert ids == sorted((i is None, i or 0) for i in want)
    else:
        assert len(ids) == len({(r.doc_id, r.text) for r in rows}) == len({r.component_id for r in simhash.digest(odd).collect()})
    if name == "pii":
        assert next(r.text for r in rows if r.doc_id == 8).startswith("mail <EMAIL> ")
    empty = stage(spark, odd.limit(0), data)
    assert empty.columns == odd.columns and empty.count() == 0


def test_the_whole_pipeline_on_odd_rows(spark, data, odd, tmp_path):
    tables = ("labels", "benchmark")
    for t in tables:
        spark.read.parquet(f"{data}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    odd.select(*SCHEMA.replace("long", "").replace("string", "").replace(" ", "").split(",")).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = {r.doc_id: r.doc_tokens for r in pieces}
    assert set(whole) >= {3, 4, 8, 9} and 7 not in whole and not {0, 1, 2} & set(whole)
    assert all(sum(r.length for r in pieces if r.doc_id == i) == n for i, n in whole.items() if i is not None)
    odd.limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_operators_on_odd_rows(spark, data, odd):
    n = odd.count()
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    for out in (lm.digest(odd), substrings.digest(odd), decontam.digest(odd, bench), simhash.digest(odd)):
        assert out.count() == n
    tokens = {r.doc_id: r.doc_tokens for r in packing.pack(odd).collect()}
    assert tokens[0] == tokens[1] == 1 and None in tokens


def test_other_types_of_doc_ids(spark):
    """The earlier one is the lesser of its own type: as strings, 10 comes before 9."""
    t = " ".join(f"w{i}" for i in range(40))
    for ids, loses in ((["9", "10", None], {"9", "10"}), (["b", "a"], {"b"}), ([2.5, 10.5], {10.5})):
        kind = "double" if isinstance(ids[0], float) else "string"
        rows = substrings.digest(spark.createDataFrame([(i, t) for i in ids], f"doc_id {kind}, text string")).collect()
        assert {r.doc_id for r in rows if r.n_removed} == loses


def test_hot_keys_are_broadcast_and_nothing_is_lost(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 100, i) for i in range(300)], "k long, v long")
    found = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    want = sorted(map(tuple, rows.join(found.drop("n"), "k").select("k", "v", "top").collect()))
    for hot in (0, 30, 10**6):
        monkeypatch.setattr(common, "HOT", hot)
        assert sorted(map(tuple, common.spread_join(rows, found, "k", 300).select("k", "v", "top").collect())) == want


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
