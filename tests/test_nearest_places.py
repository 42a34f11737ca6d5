"""Places that many points share are looked up once."""

from strandlake.operators import intervals as iv


def test_nearest_of_places_with_many_points(spark):
    points = spark.range(4000).selectExpr("id", "if(id % 2 = 0, 'a', 'b') as chrom", "id % 50 * 3 as pos")
    targets = spark.createDataFrame([("a", 10), ("a", 16), ("a", 140), ("b", 75), ("b", 75)], "chrom string, pos long")
    at = {"a": [10, 16, 140], "b": [75]}
    for size in (7, 64, 1024):
        df = iv.nearest(points, targets, size)
        assert "unboundedfollowing$" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
        got = df.collect()
        assert len(got) == 4000
        for r in got:
            assert r.distance == min((t - r.pos for t in at[r.chrom]), key=lambda d: (abs(d), d))
