import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140


def test_flagship_query(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"platform_source", "jobs"}
