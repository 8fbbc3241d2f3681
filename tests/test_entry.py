import __spark_entry__ as e


def test_every_core_query_runs(spark, data):
    import importlib

    for m in e.CORE:
        for name, f in importlib.import_module(f"lakenote.plans.{m}").QUERIES.items():
            assert f(spark, data).count() >= 0, name


def test_contract(spark):
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60
    assert e.entry(spark).count() > 0
