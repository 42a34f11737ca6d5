import pytest

from strandlake.plans import registry


@pytest.mark.parametrize("name", registry.SQL)
def test_query_equals_sql(spark, data, same, name):
    same(registry.QUERIES[name](spark, data), registry.SQL[name])


@pytest.mark.parametrize("name", ["seeded_sample", "sample_per_stratum", "epoch_batches", "gc_matched", "motif_scan", "shuffled_sequences"])
def test_draws_are_repeatable(spark, data, name):
    a, b = (sorted(map(str, registry.QUERIES[name](spark, data).collect())) for _ in range(2))
    assert a == b and a


def test_samples_and_batches(spark, data):
    import hashlib

    ids = [r.event_id for r in spark.read.parquet(f"{data}/events.parquet").select("event_id").collect()]
    drawn = {i: int(hashlib.md5(f"{i}/1".encode()).hexdigest()[:8], 16) for i in ids}
    assert {r.id for r in registry.QUERIES["seeded_sample"](spark, data).collect()} == set(sorted(ids, key=lambda i: (drawn[i], i))[:100])
    rows = registry.QUERIES["epoch_batches"](spark, data).collect()
    order = sorted(ids, key=lambda i: (int(hashlib.md5(f"{i}/3".encode()).hexdigest()[:8], 16), i))
    assert {r.id: r.batch_id for r in rows} == {i: k // 64 for k, i in enumerate(order)}


def test_entry_and_queries_import():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
