import inspect

import __spark_entry__


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() == 10
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert all(len(inspect.signature(f).parameters) == 2 for f in found.values())
