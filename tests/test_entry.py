import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "is_reference" in df.columns


def test_oracle_names_are_queries():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
