"""Rows of equal bounds are joined once."""

from strandlake.operators import intervals as iv


def test_lists_of_regions_with_equal_bounds(spark):
    hits = spark.range(3000).selectExpr("id", "'a' as chrom", "id % 3 * 10 as start", "id % 3 * 10 + 10 as end")
    regions = spark.range(2000).selectExpr("'a' as chrom", "id % 2 * 10 as b_start", "id % 2 * 10 + 20 as b_end", "id as region").unionByName(spark.createDataFrame([("b", 0, 9, -1), (None, 0, 9, -2)], "chrom string, b_start long, b_end long, region long"))
    df = iv.lists_of_contained(hits, regions, 16)
    got = {r.region: r.found for r in df.collect()}
    assert len(got) == 2002 and got[-1] == got[-2] == []
    both = [sorted(i for i in range(3000) if i % 3 in own) for own in ((0, 1), (1, 2))]
    assert all(got[k] == both[k % 2] for k in range(2000))
