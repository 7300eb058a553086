"""Every query of the library against its SQL, or, where it has none, that it runs."""

import pytest

from conftest import assert_same
from orebed.queries import FLAGSHIP, ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    got = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        assert_same(got, duck, ORACLE_SQL[name])
    else:
        assert len(got.columns) == len(set(got.columns))
        got.collect()


def test_sql_belongs_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert FLAGSHIP in QUERIES


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns
    assert set(e.oracle_sql()) <= set(e.queries())
