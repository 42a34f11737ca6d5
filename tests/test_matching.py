import hashlib

import pytest

from strandlake.operators import sampling


def drawn(ids):
    return sorted(ids, key=lambda i: (int(hashlib.md5(f"{i}/1".encode()).hexdigest()[:8], 16), i))


@pytest.mark.parametrize(("reach", "ratio"), [(None, 1), (None, 2), (2, 1)])
def test_matching_walks_on_until_candidates_run_out(spark, reach, ratio):
    p = [(i, "ab"[i % 7 == 0], 50 if i % 3 else 10) for i in range(60)]
    c = [(1000 + i, "ab"[i % 9 == 0], (i * 7) % 100) for i in range(150)]
    rows = sampling.matched_nearby(spark.createDataFrame(p, "id long, chrom string, gc long"), spark.createDataFrame(c, "id long, chrom string, gc long"), "chrom", "gc", reach, 1, ratio).collect()
    want = set()
    for g in "ab":
        left = {v: [i for i in drawn([i for i, k, x in p if (k, x) == (g, v)]) for _ in range(ratio)] for v in range(101)}
        free = {v: drawn([i for i, k, x in c if (k, x) == (g, v)]) for v in range(101)}
        for step in [0, *(s * d for d in range(1, (100 if reach is None else reach) + 1) for s in (1, -1))]:
            for v in range(101):
                while left[v] and free.get(v + step):
                    want.add((g, v + step, left[v].pop(0), free[v + step].pop(0), step))
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    if (reach, ratio) == (None, 1):
        assert len(rows) == len([x for x in p if x[1] == "a"]) + min(len([x for x in p if x[1] == "b"]), len([x for x in c if x[1] == "b"]))


def test_texts_are_read_once_for_matching(spark, data):
    from strandlake.plans import registry

    df = registry.QUERIES["gc_matched"](spark, data)
    assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()
