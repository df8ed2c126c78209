def test_queries_and_sql_belong_together():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["artifact_id", "ordinal", "snippet"]
