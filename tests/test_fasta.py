import random

import pytest

from strandlake.sources import files


@pytest.mark.parametrize("block", [97, 1000, 1 << 27])
def test_contigs_across_blocks(spark, tmp_path, block):
    """Chunks against a plain reader, in files read in blocks of any size."""
    r = random.Random(block)
    contigs = {f"chr{i}": "".join(r.choice("acgtNACGT") for _ in range(n)) for i, n in enumerate((1, 0, 700, 64, 2048, 333))}
    text = ";no contig yet\n"
    for i, (name, seq) in enumerate(contigs.items()):
        width = len(seq) or 1 if i == 4 else r.choice([7, 60])
        text += f">{name} more words\n" + "".join(seq[a : a + width] + "\n" for a in range(0, len(seq), width)) + ("\n" if i % 2 else "")
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa").write_text(">chrOther\nac gt\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = files.read_fasta(spark, str(tmp_path / "*.fa"), chunk=64).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {(n, k): s.upper()[64 * k : 64 * k + 64] for n, s in (contigs | {"chrOther": "acgt"}).items() for k in range(max(-(-len(s) // 64), 1))}
    assert {(x.chrom, x.chunk_id): x.seq for x in rows} == want and len(rows) == len(want)
    assert all(x.start == 64 * x.chunk_id for x in rows)
