"""Sources that plan their partitions: the rows of the plain readers, and only the bytes of a region."""

import random

import pytest

from strandlake.operators import assembly, tracks
from strandlake.sources import files, ranges


@pytest.fixture
def genome(tmp_path):
    rng = random.Random(1)
    seqs = {c: "".join(rng.choice("ACGTNacgt") for _ in range(n)) for c, n in (("chr1", 5003), ("chr2", 10), ("empty", 0), ("chr3", 2500), ("chr4", 60))}
    text = "".join(f">{c} some words\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for c, s in seqs.items())
    path = tmp_path / "g.fa"
    path.write_text(text)
    return str(path), seqs


def index(seqs):
    at, out = 0, []
    for c, s in seqs.items():
        at += len(f">{c} some words\n")
        out.append((c, len(s), at, min(60, len(s)), min(60, len(s)) + (len(s) > 0)))
        at += len(s) + -(-len(s) // 60)
    return out


def test_an_index_is_made_from_blocks(spark, genome, tmp_path):
    path, seqs = genome
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        ranges.write_fasta_index(spark, path, str(tmp_path / "index"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows = [tuple(r.split("\t")) for r in "".join(p.read_text() for p in (tmp_path / "index").glob("part-*")).splitlines()]
    assert [(r[0], *map(int, r[1:])) for r in rows] == index(seqs)


def test_fasta_by_its_index(spark, genome):
    path, seqs = genome
    with open(f"{path}.fai", "w") as f:
        f.writelines("\t".join(map(str, r)) + "\n" for r in index(seqs))
    df = ranges.read_fasta_ranges(spark, path, chunk=100, span=1000)
    plain = {tuple(r) for r in files.read_fasta(spark, path, 100).collect()}
    assert {tuple(r) for r in df.collect()} == plain
    assert df.rdd.getNumPartitions() == 6 + 1 + 1 + 3 + 1
    one = df.filter("chrom = 'chr1' and start >= 2100 and start < 2900")
    assert one.rdd.getNumPartitions() == 1 and {tuple(r) for r in one.collect()} == {r for r in plain if r[0] == "chr1" and 2100 <= r[2] < 2900}
    two = df.filter("chrom in ('chr3', 'chr2') and chunk_id <= 10")
    assert two.rdd.getNumPartitions() == 3 and {tuple(r) for r in two.collect()} == {r for r in plain if r[0] in ("chr3", "chr2") and r[1] <= 10}
    assert df.filter("chrom = 'other'").count() == 0
    loci = spark.createDataFrame([(1, "chr1", 950, 1100), (2, "chr3", 2450, 2520)], "id long, chrom string, start long, end long")
    got = {r.id: r.seq for r in assembly.fetched(loci, df, 100).collect()}
    assert got == {1: seqs["chr1"][950:1100].upper(), 2: seqs["chr3"][2450:].upper() + "N" * 20}


@pytest.mark.parametrize(("block", "sep"), [(64, "\t"), (300, "\t"), (1 << 20, " ")])
def test_bedgraph_by_blocks(spark, tmp_path, block, sep):
    rng = random.Random(block)
    rows, lines = [], ["track type=bedGraph", "# words"]
    for c in ("chr1", "chr10", "s", "chr2"):
        at = 0
        for _ in range({"s": 2}.get(c, 150)):
            at += rng.choice([0, 5, 1000])
            n = rng.choice([1, 7, 400])
            rows.append((c, at, at + n, float(rng.randrange(9))))
            at += n
    lines += [sep.join(map(str, r)) for r in rows]
    path = tmp_path / "t.bedGraph"
    path.write_text("\n".join(lines) + ("\n" if block != 300 else ""))
    df = ranges.read_bedgraph_ranges(spark, str(path), block=block)
    assert sorted(map(tuple, df.collect())) == sorted(rows)
    whole = df.rdd.getNumPartitions()
    for c in ("chr1", "chr10", "s", "chr2", "none"):
        for a, b in ((0, 1 << 40), (20_000, 22_000), (0, 1)):
            some = df.filter(f"chrom = '{c}' and start < {b} and end > {a}")
            assert sorted(map(tuple, some.collect())) == sorted(r for r in rows if r[0] == c and r[1] < b and r[2] > a)
            if block == 64 and c == "chr10" and b < 1 << 40:
                assert some.rdd.getNumPartitions() < whole / 10
    loci = spark.createDataFrame([(1, "chr10", 0, 3000)], "id long, chrom string, start long, end long")
    got = list(tracks.dense(loci, df).first()["values"])
    want = [0.0] * 3000
    for c, a, b, x in rows:
        if c == "chr10":
            for i in range(a, min(b, 3000)):
                want[i] = x
    assert got == want


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.bg").write_text("")
    (tmp_path / "head.bg").write_text("track type=bedGraph\n# nothing\n")
    for name in ("empty.bg", "head.bg"):
        assert ranges.read_bedgraph_ranges(spark, str(tmp_path / name)).count() == 0
