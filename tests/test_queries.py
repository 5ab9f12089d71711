"""Every query with SQL gives the SQL's rows; the others give rows."""

import compare
import pytest

from cargosift.plans import oracles, queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    if name in oracles.SQL:
        assert compare.differ(queries.QUERIES[name], oracles.SQL[name], spark, sf_dir) is None
    else:
        assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
