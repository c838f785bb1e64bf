import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert {k for k in E.queries() if k not in E.LLM} == {k for k in E.oracle_sql() if k not in E.LLM}
