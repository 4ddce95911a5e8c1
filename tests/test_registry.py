import __spark_entry__ as entry


def test_entry_and_registry(spark):
    frame = entry.entry(spark)
    assert frame.limit(1).count() == 1 and "hard_hit_rate" in frame.columns
    names, oracle = set(entry.queries()), set(entry.oracle_sql())
    assert oracle <= names and len(names) > 200 and len(oracle) > 190
