"""Examples, row selection, stores and run files on small cases."""

import math
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from strandlake.functions import profile as pf
from strandlake.operators import assembly, intervals, predictions, sampling
from strandlake.sources import files, stores


def test_sequences_and_tracks_of_a_small_genome(spark, tmp_path):
    fa = tmp_path / "mini.fa"
    fa.write_text(">chr1 first\nACGTacgtNN\nTTTT\n>chr2\nGGGGG\nCCCCC\nAA\n")
    chunks = files.read_fasta(spark, str(fa), 4)
    assert {(r.chrom, r.chunk_id, r.start, r.seq) for r in chunks.collect()} == {("chr1", 0, 0, "ACGT"), ("chr1", 1, 4, "ACGT"), ("chr1", 2, 8, "NNTT"), ("chr1", 3, 12, "TT"), ("chr2", 0, 0, "GGGG"), ("chr2", 1, 4, "GCCC"), ("chr2", 2, 8, "CCAA")}
    loci = spark.createDataFrame([(1, "chr1", 2, 9), (2, "chr2", 10, 15), (3, "chr3", 0, 3), (4, "chr1", 20, 22)], "id long, chrom string, start long, end long")
    assert {r.id: r.seq for r in assembly.fetched(loci, chunks, 4).collect()} == {1: "GTACGTN", 2: "AANNN", 3: "NNN", 4: "NN"}
    with pytest.raises(Exception, match="out of range"):
        assembly.fetched(loci, chunks, 4, beyond="error").collect()
    track = spark.createDataFrame([("chr1", i, 10 * i) for i in range(5)], "chrom string, start long, value long")
    assert {r.id: list(r["values"]) for r in assembly.dense(loci.filter("id = 1"), track).collect()} == {1: [20, 30, 40, 0, 0, 0, 0]}


def test_both_strands(spark):
    x = spark.createDataFrame([(1, "AACGN", [1.0, 2.0], [3.0, 4.0])], "id long, seq string, plus array<double>, minus array<double>")
    assert {(r.rev_comp, r.seq, tuple(r.plus), tuple(r.minus)) for r in assembly.both_strands(x).collect()} == {(0, "AACGN", (1, 2), (3, 4)), (1, "NCGTT", (4, 3), (2, 1))}
    r = x.select(pf.strand_swapped(F.col("plus"), F.col("minus")).alias("s")).first().s
    assert (r.plus, r.minus) == ([4, 3], [2, 1])


def test_bias_tracks(spark):
    df = spark.createDataFrame([(["a", "b"], [7.0, None]), ([], [])], "s array<string>, m array<double>")
    assert [r[0] for r in df.select(assembly.bias_tracks(F.col("s"), F.col("m"))).collect()] == [3, 0]
    with pytest.raises(Exception, match="smoothing"):
        spark.createDataFrame([(["a"], [])], "s array<string>, m array<double>").select(assembly.bias_tracks(F.col("s"), F.col("m"))).collect()


def test_batches_fit_threads():
    assert sampling.batch_plan(1000, 64, 3) == (960, 64, 3)
    assert sampling.batch_plan(100, 64, 2) == (64, 32, 2)
    assert sampling.batch_plan(2, 8, 3) == (2, 1, 2)
    with pytest.raises(ValueError):
        sampling.batch_plan(0, 4, 2)


def test_rows_by_number(spark):
    df = spark.createDataFrame([(i * 40_000, "ab"[i % 2]) for i in range(9)], "id long, chrom string")
    index = spark.createDataFrame([(0,), (5,), (5,), (99,)], "row_idx long")
    assert sorted(r.id for r in sampling.by_index(df, "id", index).collect()) == [0, 200_000]
    assert sampling.by_index(df, "id", index, ["a"]).count() == 5


def test_nulls_in_other_columns_do_not_matter_to_overlap_joins(spark):
    a = spark.createDataFrame([("c", 0, 10, None), ("c", 50, 60, None), ("c", 0, 10, "x")], "chrom string, start long, end long, name string")
    b = spark.createDataFrame([("c", 5, 8)], "chrom string, b_start long, b_end long")
    assert [tuple(r) for r in intervals.overlap_join(a, b, 16, how="left_anti").collect()] == [("c", 50, 60, None)]
    assert sorted(map(str, intervals.overlap_join(a, b, 16, how="left_semi").collect())) == sorted(map(str, a.filter("start = 0").collect()))


def test_metric_gate(spark):
    x = spark.createDataFrame([(1, [0.0] * 4, [1.0] * 4), (2, [1.0, 2.0, 3.0, 4.0], [1.0, 1.0, 1.0, 1.0])], "id long, truth array<double>, predicted array<double>")
    rows = {r.id: r for r in predictions.metrics(x, 1.0, 3).collect()}
    assert tuple(rows[1])[1:] == (0, 0, 0, 0, 0)
    assert rows[2].pearson == rows[2].spearman == 0 and rows[2].mse == 14 / 4 and rows[2].jsd > 0


def test_stores(spark, tmp_path):
    rows = [("chr1", 5, 9, 0, [1.0, 2.0], 0.5, [2.0, 1.0], 0.4), ("chr2", 1, 5, 0, [1.0, 2.0], 0.5, [2.0, 1.0], 0.4)]
    p = spark.createDataFrame(rows, stores.PREDICTIONS)
    stores.write_store(p, f"{tmp_path}/p", stores.PREDICTIONS)
    both = stores.read_predictions(spark, f"{tmp_path}/p", f"{tmp_path}/p")
    assert both.count() == 4 and sorted(tuple(r)[:8] for r in both.filter("member = 1").collect()) == sorted((*r[:4], r[4], *r[5:]) for r in rows)
    hot = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 0], [0, 0, 1, 0]]
    a = spark.createDataFrame([("chr1", 0, 4, 0, hot, [[float(i)] * 4 for i in range(4)]), ("chr2", 0, 4, 1, hot[:2] * 2, [[math.nan] * 4] * 4)], stores.ATTRIBUTIONS)
    stores.write_store(a, f"{tmp_path}/a", stores.ATTRIBUTIONS)
    cut = stores.read_attributions(spark, f"{tmp_path}/a", centre=2, chroms=["chr1"]).first()
    assert cut.hot == hot[1:3] and cut.scores == [[1.0] * 4, [2.0] * 4]
    assert [r.chrom for r in stores.read_attributions(spark, f"{tmp_path}/a", only_acgt=True).collect()] == ["chr2"]
    members = a.withColumn("member", F.lit(0)).unionByName(a.withColumn("scores", F.transform("scores", lambda r: F.transform(r, lambda x: x + 2))).withColumn("member", F.lit(1)))
    mean = {(r.chrom, r.pos, r.base): r.score for r in stores.mean_attributions(members).collect()}
    assert mean["chr1", 3, 0] == 4.0 and mean["chr2", 0, 0] is None
    stores.write_store(spark.createDataFrame([("chr1", 0, 4, "top", [1.0])], stores.EMBEDDINGS), f"{tmp_path}/e", stores.EMBEDDINGS)
    stores.write_store(spark.createDataFrame([("jsd", "+", 1, 0.5)], stores.METRICS), f"{tmp_path}/m", stores.METRICS)
    assert spark.read.parquet(f"{tmp_path}/m").first().value == 0.5
    m = spark.createDataFrame([("m", 0, 0.1, 0.2, 0.3, 0.4), ("m", 1, 1.0, 0.0, 0.0, 0.0)], "motif string, pos int, a double, c double, g double, t double")
    stores.write_pfm(m, f"{tmp_path}/pfm")
    assert [r.value for r in spark.read.text(f"{tmp_path}/pfm/motif=m").collect()] == ["0.100000 1.000000", "0.200000 0.000000", "0.300000 0.000000", "0.400000 0.000000"]
    stores.write_gc_bed(spark.createDataFrame([("c", 0, 5, 40)], "chrom string, st long, end long, gc long"), f"{tmp_path}/gc")
    assert files.read_gc_bed(spark, f"{tmp_path}/gc").first().gc == 0.4


def test_runs(spark, tmp_path):
    assert stores.folds({"0": {"val": ["b"], "test": ["c"]}}, list("abcd")) == {"0": {"train": ["a", "d"], "val": ["b"], "test": ["c"]}}
    assert stores.run_tag(datetime(2024, 7, 1, 3, 4, 5, tzinfo=UTC), "America/New_York") == "2024-06-30_23_04_05"
    assert spark.sql("select timestamp'2024-07-01 03:04:05' as t").select(stores.time_tag(F.col("t"), "America/New_York")).first()[0] == "2024-06-30_23_04_05"
    stores.write_run(f"{tmp_path}/run.json", {"rate": 1}, [{"epoch": 1, "loss": 2.0}])
    config, history = stores.read_run(spark, f"{tmp_path}/run.json")
    assert config == {"rate": 1} and [tuple(r) for r in history.collect()] == [(1, 2.0)]
    assert files.read_indices(spark, _written(tmp_path, "3\n\n 7\n")).count() == 2


def _written(folder, text):
    (folder / "x.txt").write_text(text)
    return str(folder / "x.txt")
