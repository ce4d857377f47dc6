import __spark_entry__ as E


def test_contract_shape():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 38
    assert all(callable(f) for f in q.values())
    assert all(isinstance(s, str) and "SELECT" in s.upper() for s in sql.values())


def test_entry_flagship(spark):
    df = E.entry(spark)
    assert df.columns == ["project", "total_files", "miss_files", "new_files", "changed_files", "change_ratio",
                          "has_cached", "regenerate"]
    rows = df.collect()
    assert len(rows) == 20 and all(r["total_files"] == r["miss_files"] + (r["total_files"] - r["miss_files"])
                                   for r in rows)
