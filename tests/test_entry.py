import __spark_entry__ as entry


def test_entry_runs_on_smoke_data(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"cluster", "gene", "avg_log2fc"}


def test_every_oracle_has_a_query():
    q = entry.queries()
    sql = entry.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 100


def test_missing_training_part_leaves_the_rest(monkeypatch):
    def missing(name):
        raise ImportError(name)
    monkeypatch.setattr(entry.importlib, "import_module", missing)
    assert entry._llm() == {}
