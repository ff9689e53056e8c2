import __spark_entry__ as entry
import pytest
from oracle import same
from stagelens import queries as core


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_core_query(spark, sf_dir, name):
    df = core.QUERIES[name](spark, sf_dir)
    if name in core.ORACLE:
        same(df, core.ORACLE[name], sf_dir)
    else:
        assert df.count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
