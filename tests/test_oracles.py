"""Every registered query with SQL gives the SQL's rows."""

import math

import pytest
from conftest import SMALL

from tessera import plans


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "is_finite"):  # a decimal
        return float(value)
    return value


def same_rows(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    ours = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    order = [relation.columns.index(c) for c in columns]
    theirs = sorted(str([plain(r[i]) for i in order]) for r in relation.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, duck, name):
    same_rows(plans.QUERIES[name](spark, SMALL), duck.sql(plans.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
