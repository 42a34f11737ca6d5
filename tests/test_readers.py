"""Readers that tell what they leave out, and stores with a schema of their own."""

import json
import math

import pytest
from pyspark.sql import functions as F

from strandlake.functions import sequence as sq
from strandlake.sources import files, stores


def test_bad_scan_lines_are_kept_apart(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("chr1:100-200,k.pfm,5,+,7.5,ACGT,\nno line at all\nchr1:100-200,k.pfm,x,+,7.5,ACGT,\nchr2:7-9,m.pfm,1,-,2.0,AC\n")
    assert sorted(map(tuple, files.read_scan_csv(spark, str(path)).collect())) == [("chr1", 105, 109, "k", "+", 7.5), ("chr2", 8, 10, "m", "-", 2.0)]
    assert sorted(r.bad for r in files.bad_scan_lines(spark, str(path)).collect()) == ["chr1:100-200,k.pfm,x,+,7.5,ACGT,", "no line at all"]
    with pytest.raises(Exception, match="bad line"):
        files.read_scan_csv(spark, str(path), strict=True).collect()


def test_similarity_has_numbers(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("Query_ID\tTarget_ID\tOptimal_offset\tp-value\tOrientation\tOther\nm1\tT\t-2\t1e-5\t+\t7\n\n# a comment\n")
    df = files.read_similarity(spark, str(path))
    assert dict(df.dtypes)["Optimal_offset"] == "bigint" and dict(df.dtypes)["p-value"] == "double" and dict(df.dtypes)["Other"] == "string"
    assert df.filter("`p-value` < 0.001 and Optimal_offset < 0").first()[:] == ("m1", "T", -2, 1e-5, "+", "7")


def test_settings_come_by_sparks_readers(spark, tmp_path):
    files.write_text(json.dumps({"0": {"a": 1}, "x": 2}), f"{tmp_path}/tasks")
    assert files.read_tasks(f"{tmp_path}/tasks") == {0: {"a": 1}, "x": 2}
    (tmp_path / "two").mkdir()
    for name in "ab":
        (tmp_path / "two" / name).write_text("{}")
    with pytest.raises(ValueError, match="2 files"):
        files.read_splits(f"{tmp_path}/two")


def test_metrics_come_back_as_arrays(spark, tmp_path):
    rows = [("jsd", s, i, i / 10 + (s == "+")) for s in "+-" for i in range(3)] + [("counts_mse", "+", 0, 4.0), ("counts_mse", "-", 0, 5.0)]
    stores.write_store(spark.createDataFrame(rows, stores.METRICS), f"{tmp_path}/m", stores.METRICS)
    got = {r.metric: list(r["values"]) for r in stores.read_metrics(spark, f"{tmp_path}/m").collect()}
    assert got == {"jsd": [1.0, 1.1, 1.2, 0.0, 0.1, 0.2], "counts_mse": [4.0, 5.0]}
    assert stores.read_metrics(spark, f"{tmp_path}/m", ["other"]).count() == 0
    by = {(r.metric, r.strand): (r.n, r.least, r.middle, r.most) for r in stores.metrics_by_strand(spark, f"{tmp_path}/m").collect()}
    assert by["jsd", "-"] == (3, 0.0, 0.1, 0.2)


def test_discovered_motifs(spark, tmp_path):
    flat, sharp = (0.25, 0.25, 0.25, 0.25), (1.0, 0.0, 0.0, 0.0)
    rows = [(0, 0, i, *(sharp if i in (1, 3) else flat), 0.1, 0.0, 0.0, 0.0) for i in range(5)] + [(1, 2, i, *sharp, -1.0, 0.0, 0.0, 0.5) for i in range(2)]
    spark.createDataFrame(rows, stores.MOTIFS).write.parquet(f"{tmp_path}/m")
    assert {(r.motif, r.pos) for r in stores.read_motifs(spark, f"{tmp_path}/m").collect()} == {("0_0", i) for i in range(5)}
    assert {(r.motif, r.pos) for r in stores.read_motifs(spark, f"{tmp_path}/m", trim=0.5).collect()} == {("0_0", i) for i in (1, 2, 3)}
    assert stores.read_motifs(spark, f"{tmp_path}/m", only_positive=False).filter("motif = '1_2'").count() == 2


def test_ensembles(spark, tmp_path):
    rows = [("c", 0, 2, t, [1.0, 2.0], 0.5, p, n) for t, p, n in ((0, [1.0, 3.0], 2.0), (1, [0.0, 2.0], 1.0))]
    more = [("c", 0, 2, 0, [9.0, 9.0], 9.0, [3.0, 1.0], 4.0), ("c", 0, 2, 1, [9.0, 9.0], 9.0, [1.0, 1.0], 1.0)]
    alone = [("d", 0, 2, 0, [1.0, 1.0], 0.0, [1.0, 1.0], 0.0)]
    for name, part in (("a", rows + alone), ("b", more)):
        stores.write_store(spark.createDataFrame(part, stores.PREDICTIONS), f"{tmp_path}/{name}", stores.PREDICTIONS)
    mean = stores.ensembled(stores.read_predictions(spark, f"{tmp_path}/a", f"{tmp_path}/b"))
    stores.write_ensemble(mean, f"{tmp_path}/e")
    got = {(r.chrom, r.track): r for r in stores.read_ensemble(spark, f"{tmp_path}/e", 2).collect()}
    assert set(got) == {("c", 0), ("c", 1)} and got["c", 0].members == 2
    assert got["c", 0].predicted_profile == pytest.approx([math.exp(3) / 2] * 2) and list(got["c", 0].true_profile) == [1.0, 2.0]
    assert got["c", 1].predicted_profile == pytest.approx([0.0, math.e])
    assert stores.read_ensemble(spark, f"{tmp_path}/e", 3).count() == 0


def test_letters_that_are_no_bases_fail(spark):
    df = spark.createDataFrame([("ACNR",)], "s string")
    assert [list(x) for x in df.select(sq.one_hot(F.col("s"), strict=True)).first()[0]] == [[1, 0, 0, 0], [0, 1, 0, 0], [0] * 4, [0] * 4]
    with pytest.raises(Exception, match="no bases: AX"):
        spark.createDataFrame([("AX",)], "s string").select(sq.one_hot(F.col("s"), strict=True)).collect()
